"""Filling depressions, tile by tile."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perilframe.operators.forest import least_barriers
from perilframe.operators.iterate import discard, stored

#: Rows and columns of a tile.
TILE = 256
#: What cells without a value count as; they let water through but are no outlets.
NO_DATA = -9999.0
OUTLET = -1
_AROUND = [(dr, dc) for dr in (-1, 0, 1) for dc in (-1, 0, 1) if dr or dc]


class Grid:
    """A tile's cells on a padded grid, by flat places; ``here`` tells which places are cells."""

    def __init__(self, row: np.ndarray, col: np.ndarray, rim: int = 1):
        self.top, self.left = int(row.min()) - rim, int(col.min()) - rim
        self.width = int(col.max()) - self.left + 1 + rim
        self.size = self.width * (int(row.max()) - self.top + 1 + rim)
        self.at = self.place(row, col)
        self.steps = [dr * self.width + dc for dr, dc in _AROUND]
        self.here = np.zeros(self.size, bool)
        self.here[self.at] = True

    def place(self, row: np.ndarray, col: np.ndarray) -> np.ndarray:
        return (row - self.top).astype(np.int64) * self.width + (col - self.left)

    def inside(self) -> np.ndarray:
        """How many of each cell's eight neighbours are cells here."""
        return sum(self.here[self.at + s].astype(np.int32) for s in self.steps)


_LOCAL = "kind int, row int, col int, a long, b long, w double, inside int"


def _flooded(frame: pd.DataFrame) -> pd.DataFrame:
    """A tile as if water left it everywhere at its border.

    Kind 0: each cell's basin ``a`` (named by the border cell that drains it) and level, and for border cells the number of
    neighbours inside. Kind 1: the lowest pass ``w`` between basins a and b. Water rises from the lowest border cell on.
    """
    row, col = frame["row"].to_numpy(np.int64), frame["col"].to_numpy(np.int64)
    grid = Grid(row, col)
    inside = grid.inside()
    low = np.zeros(grid.size)
    low[grid.at] = frame["z"].fillna(NO_DATA).to_numpy(float)
    z, here, level = low.tolist(), grid.here.tolist(), low.tolist()
    basin, done = [-1] * grid.size, [False] * grid.size
    heap = [(z[i], i) for i in grid.at[inside < 8].tolist()]
    heapq.heapify(heap)
    passes: dict[tuple[int, int], float] = {}
    while heap:
        v, i = heapq.heappop(heap)
        if done[i]:
            continue
        done[i] = True
        if basin[i] < 0:
            basin[i] = i
        own = basin[i]
        for s in grid.steps:
            j = i + s
            if not here[j]:
                continue
            other = basin[j]
            if other < 0:
                basin[j] = own
                if z[j] < v:
                    level[j] = v
                heapq.heappush(heap, (level[j], j))
            elif other != own:
                key = (own, other) if own < other else (other, own)
                w = v if v > level[j] else level[j]
                if w < passes.get(key, np.inf):
                    passes[key] = w
    name = lambda i: (i // grid.width + grid.top) * 2**31 + i % grid.width + grid.left
    own = np.array(basin, np.int64)[grid.at]
    cells = pd.DataFrame({"kind": 0, "row": row, "col": col, "a": name(own), "b": 0, "w": np.array(level)[grid.at], "inside": pd.array(np.where(inside < 8, inside, -1), dtype="Int32")})
    pairs = np.array(list(passes), np.int64).reshape(-1, 2)
    edges = pd.DataFrame({"kind": 1, "row": 0, "col": 0, "a": name(pairs[:, 0]), "b": name(pairs[:, 1]), "w": list(passes.values()), "inside": pd.array([-1] * len(pairs), dtype="Int32")})
    return pd.concat([cells, edges]) if len(pairs) else cells


def _tile(column: str, tile: int):
    return F.floor(F.col(column) / tile).cast("long")


def _beside(border: DataFrame) -> DataFrame:
    """border with a row for each of the eight places around a cell (row2, col2)."""
    steps = F.array(*(F.struct(F.lit(dr).alias("r"), F.lit(dc).alias("c")) for dr, dc in _AROUND))
    return border.withColumn("_s", F.explode(steps)).withColumn("row2", F.col("row") + F.col("_s.r")).withColumn("col2", F.col("col") + F.col("_s.c")).drop("_s")


def fill_depressions(cells: DataFrame, z: str = "z", eps: float = 0.0, tile: int = TILE) -> DataFrame:
    """cells (row, col, z) with ``filled``: the least level at which each cell's water reaches the layer's edge.

    Edge cells, those without all eight neighbours, keep their z. Cells without a value count as NO_DATA and are no
    outlets. ``eps``: every cell on the way out lies at least so much above the next; see ``_drained``.

    Tiles are flooded on their own, from their borders. What they share is a graph: basins, the lowest passes between
    those of a tile, and the steps between neighbouring border cells of two tiles; its size goes with the tiles'
    circumference. A basin's level is its least barrier to the outlets (``least_barriers``), so that rounds are the
    logarithm of the number of basins, however long the ways; a cell's is the larger of that and its own in the tile.
    """
    if eps:
        return _drained(cells, z, eps, tile)
    mine = cells.select("row", "col", F.col(z).cast("double").alias("z"), _tile("row", tile).alias("tr"), _tile("col", tile).alias("tc"))
    local = stored(mine.groupBy("tr", "tc").applyInPandas(_flooded, _LOCAL), "tiles")
    border = local.where("kind = 0 and inside >= 0").select("row", "col", "a", "w", "inside")
    other = border.select(F.col("row").alias("row2"), F.col("col").alias("col2"), F.col("a").alias("b"), F.col("w").alias("w2"))
    apart = (_tile("row", tile) != _tile("row2", tile)) | (_tile("col", tile) != _tile("col2", tile))
    steps = stored(_beside(border).where(apart).join(other, ["row2", "col2"]).select("row", "col", "a", "b", F.greatest("w", "w2").alias("w")), "steps")
    near = steps.groupBy("row", "col").agg(F.count(F.lit(1)).alias("outside"))
    outlets = border.join(near, ["row", "col"], "left").where((F.col("inside") + F.coalesce("outside", F.lit(0)) < 8) & (F.col("w") > NO_DATA)).select("a", F.lit(OUTLET).cast("long").alias("b"), "w")
    edges = local.where("kind = 1").select("a", "b", "w").unionByName(steps.select("a", "b", "w")).unionByName(outlets)
    levels, _ = least_barriers(edges, OUTLET)
    found = local.where("kind = 0").select("row", "col", "a", "w").join(levels.withColumnRenamed("node", "a"), "a", "left")
    out = found.select("row", "col", F.greatest("w", "level").alias("filled"))
    return cells.join(out, ["row", "col"])


def _drained(cells: DataFrame, z: str, eps: float, tile: int) -> DataFrame:
    """cells with ``filled``: the least levels such that each cell but the edge ones lies eps above a neighbour, or at its z if that is higher.

    Tiles are solved whole, given the levels of the cells around them, and only border cells' levels are
    exchanged; a tile is solved again when one of them has fallen. Rounds go with the number of tiles on the longest way.
    """
    key = ["tr", "tc"]
    own = cells.select("row", "col", F.col(z).cast("double").alias("z"), _tile("row", tile).alias("tr"), _tile("col", tile).alias("tc"))
    local = own.groupBy(*key).applyInPandas(lambda f: f[["tr", "tc", "row", "col", "z"]].assign(inside=Grid(f["row"].to_numpy(), f["col"].to_numpy()).inside()), "tr long, tc long, row int, col int, z double, inside int")
    local = stored(local, "tiles")
    border = local.where("inside < 8").select("row", "col", "inside")
    outside = _beside(border).join(border.select(F.col("row").alias("row2"), F.col("col").alias("col2")), ["row2", "col2"])
    outside = outside.where((_tile("row", tile) != _tile("row2", tile)) | (_tile("col", tile) != _tile("col2", tile))).groupBy("row", "col").agg(F.count(F.lit(1)).alias("outside"))
    outlet = (F.col("inside") + F.coalesce("outside", F.lit(0)) < 8) & F.col("z").isNotNull()
    tiles = stored(local.join(outside, ["row", "col"], "left").select(*key, "row", "col", "z", outlet.alias("outlet")), "tiles")

    def solve(around: pd.DataFrame, mine: pd.DataFrame) -> tuple[Grid, np.ndarray]:
        grid = Grid(mine["row"].to_numpy(), mine["col"].to_numpy(), rim=2)
        low, level = np.full(grid.size, np.inf), np.full(grid.size, np.inf)
        low[grid.at] = mine["z"].fillna(NO_DATA)
        heap = [(v, i) for v, i, on in zip(low[grid.at].tolist(), grid.at.tolist(), mine["outlet"]) if on]
        level[[i for _, i in heap]] = [v for v, _ in heap]
        at = grid.place(around["row"].to_numpy(), around["col"].to_numpy())
        level[at] = around["level"].to_numpy()
        heap += list(zip(level[at].tolist(), at.tolist()))
        heapq.heapify(heap)
        low, level, here = low.tolist(), level.tolist(), grid.here.tolist()
        while heap:
            v, i = heapq.heappop(heap)
            if v > level[i]:
                continue
            for s in grid.steps:
                j = i + s
                if 0 <= j < grid.size and here[j]:
                    w = max(low[j], v + eps)
                    if w < level[j]:
                        level[j] = w
                        heapq.heappush(heap, (w, j))
        return grid, np.array(level)[grid.at]

    def borders(_, mine: pd.DataFrame, around: pd.DataFrame) -> pd.DataFrame:
        if not len(mine):
            return pd.DataFrame({"row": [], "col": [], "level": []})
        grid, level = solve(around, mine)
        k = np.flatnonzero((grid.inside() < 8) & np.isfinite(level))
        return pd.DataFrame({"row": mine["row"].to_numpy()[k], "col": mine["col"].to_numpy()[k], "level": level[k]})

    def whole(_, mine: pd.DataFrame, around: pd.DataFrame) -> pd.DataFrame:
        return mine[["row", "col"]].assign(filled=solve(around, mine)[1] if len(mine) else [])

    around_schema = "row int, col int, level double"
    halo = lambda known: _beside(known).select("row", "col", "level", _tile("row2", tile).alias("tr"), _tile("col2", tile).alias("tc")).where((F.col("tr") != _tile("row", tile)) | (F.col("tc") != _tile("col", tile))).distinct()  # noqa: E731  of tiles, or of places without any
    spark = cells.sparkSession
    known = stored(spark.createDataFrame([], around_schema + ", moved boolean"), "borders")
    active = tiles
    while True:
        about = halo(known.drop("moved"))
        found = active.groupBy(*key).cogroup(about.join(active.select(*key).distinct(), key, "left_semi").groupBy(*key)).applyInPandas(borders, around_schema)
        both = found.withColumn("fresh", F.lit(True)).unionByName(known.select("row", "col", "level").withColumn("fresh", F.lit(False)))
        less = F.min(F.when(F.col("fresh"), F.col("level"))) < F.coalesce(F.min(F.when(~F.col("fresh"), F.col("level"))), F.lit(float("inf")))
        new = stored(both.groupBy("row", "col").agg(F.min("level").alias("level"), F.coalesce(less, F.lit(False)).alias("moved")), "borders")
        discard(known)
        known = new
        again = halo(known.where("moved").drop("moved")).select(*key).distinct()
        if known.where("moved").isEmpty():
            break
        active = tiles.join(again, key, "left_semi")
    out = tiles.groupBy(*key).cogroup(halo(known.drop("moved")).groupBy(*key)).applyInPandas(whole, "row int, col int, filled double")
    return cells.join(stored(out, "filled"), ["row", "col"])
