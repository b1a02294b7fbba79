"""Earliest arrivals over a grid's edges, by buckets of time and tiles of cells."""

from __future__ import annotations

import heapq
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perilframe.operators.iterate import discard, stored

#: Rows and columns of a tile, sources that a task takes with it, and buckets of a budget unless told otherwise.
TILE, SOURCES, BUCKETS = 64, 64, 4


def reach_within_budget(edges: DataFrame, sources: DataFrame, budget: float, delta: float | None = None, tile: int = TILE) -> DataFrame:
    """(source_id, row, col, arrival): the earliest arrival within a budget of minutes, for many sources at once; see ``reach``."""
    return reach(edges, sources, budget, delta, tile)[0]


def reach(edges: DataFrame, sources: DataFrame, budget: float, delta: float | None = None, tile: int = TILE, tell: bool = False) -> tuple[DataFrame, dict[str, int]]:
    """The arrivals, and the numbers of buckets, of steps in them, and, to ``tell``, of cells solved (``solved``) and settled.

    edges has row, col, row2, col2 and minutes, not negative; sources source_id, row and col. Time goes on in buckets
    of ``delta`` minutes (the budget over BUCKETS). In a bucket, each tile that something enters is solved whole, by a
    heap from the cells entered and no farther than the bucket's end; what it sends to other tiles within the
    bucket makes the next step. At the end its cells are settled: written once, and never again; only what
    reaches beyond is carried on. So steps go with the budget over delta, and the tiles crossed in delta minutes.
    A tile's sources are dealt to tasks, SOURCES at a time.
    """
    delta = delta or budget / BUCKETS or 1.0
    at, own = ["source_id", "row", "col"], ["tr", "tc", "part"]
    kind = sources.schema["source_id"].dataType.simpleString()
    tile_of = lambda c: F.floor(F.col(c) / tile).cast("long")
    tiles = stored(edges.select("row", "col", "row2", "col2", "minutes", tile_of("row").alias("tr"), tile_of("col").alias("tc")), "edges")
    parts = -(-sources.select("source_id").distinct().count() // SOURCES) or 1
    least = lambda df: df.groupBy(*at).agg(F.min("arrival").alias("arrival"))
    pending = stored(least(sources.select(*at, F.lit(0.0).alias("arrival"))), "pending")
    settled: list[DataFrame] = []
    told = {"buckets": 0, "steps": 0, "solved": 0, "settled": 0}

    def unsettled(df: DataFrame) -> DataFrame:
        return reduce(lambda d, s: d.join(s.select(*at), at, "left_anti"), [union(settled)] if settled else [], df)

    def solver(limit: float):
        def solve(key: tuple, seeds: pd.DataFrame, steps: pd.DataFrame) -> pd.DataFrame:
            out: dict[tuple[int, int], list[tuple[int, int, float]]] = {}
            for r, c, r2, c2, m in steps[["row", "col", "row2", "col2", "minutes"]].itertuples(index=False):
                out.setdefault((r, c), []).append((r2, c2, m))
            rows = []
            for source, some in seeds.groupby("source_id", sort=False):
                heap = list(zip(some["arrival"], some["row"], some["col"]))
                heapq.heapify(heap)
                done: set[tuple[int, int]] = set()
                beyond: dict[tuple[int, int], float] = {}
                while heap:
                    t, r, c = heapq.heappop(heap)
                    if (r, c) in done:
                        continue
                    done.add((r, c))
                    rows.append((source, r, c, t, True))
                    for r2, c2, m in out.get((r, c), ()):
                        if t + m >= limit or (r2 // tile, c2 // tile) != key[:2]:
                            if t + m <= budget:
                                beyond[r2, c2] = min(beyond.get((r2, c2), t + m), t + m)
                        elif (r2, c2) not in done and t + m <= budget:
                            heapq.heappush(heap, (t + m, r2, c2))
                rows += [(source, r, c, t, False) for (r, c), t in beyond.items()]
            return pd.DataFrame(rows, columns=[*at, "arrival", "inside"])

        return solve

    while (low := pending.agg(F.min("arrival")).first()[0]) is not None:
        limit = (low // delta + 1) * delta
        told["buckets"] += 1
        later, best = [pending.where(F.col("arrival") >= limit)], None
        seeds, passed = stored(pending.where(F.col("arrival") < limit), "seeds"), []
        while not seeds.isEmpty():
            told["steps"] += 1
            dealt = seeds.select(*at, "arrival", tile_of("row").alias("tr"), tile_of("col").alias("tc"), F.pmod(F.xxhash64("source_id"), F.lit(parts)).alias("part"))
            mine = dealt.select(*(F.col(c).alias(f"_{c}") for c in own)).distinct().join(tiles, (F.col("_tr") == F.col("tr")) & (F.col("_tc") == F.col("tc"))).drop("tr", "tc")
            out = stored(dealt.groupBy(*own).cogroup(mine.groupBy(*(f"_{c}" for c in own))).applyInPandas(solver(limit), f"source_id {kind}, row int, col int, arrival double, inside boolean"), "solved")
            passed.append(out)
            reached = out.where("inside").drop("inside")
            new = stored(least(reached if best is None else best.unionByName(reached)), "bucket")
            discard(seeds, *([best] if best is not None else []))
            best = new
            later.append(out.where(~F.col("inside") & (F.col("arrival") >= limit)).drop("inside"))
            within = least(out.where(~F.col("inside") & (F.col("arrival") < limit)).drop("inside"))
            known = best.select(*at, F.col("arrival").alias("_known"))
            seeds = stored(unsettled(within.join(known, at, "left").where("_known is null or arrival < _known").drop("_known")), "seeds")
        discard(seeds)
        settled.append(stored(unsettled(best), "settled"))
        if tell:
            told["solved"] += sum(p.where("inside").count() for p in passed)
            told["settled"] += settled[-1].count()
        new = stored(unsettled(least(union(later))), "pending")
        discard(pending, best, *passed)
        pending = new
    discard(pending, tiles)
    empty = sources.sparkSession.createDataFrame([], f"source_id {kind}, row int, col int, arrival double")
    return union(settled) if settled else empty, told


def union(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)
