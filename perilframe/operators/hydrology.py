"""Drainage of cells and floods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from perilframe.operators.filling import fill_depressions
from perilframe.operators.grid import nbr3x3, nearest_where
from perilframe.operators.iterate import discard, stored
from perilframe.operators.terrain import wetness

#: Neighbours in order of direction codes: name, row step, column step.
DIRECTIONS = [("n_nw", -1, -1), ("n_n", -1, 0), ("n_ne", -1, 1), ("n_w", 0, -1), ("n_e", 0, 1), ("n_sw", 1, -1), ("n_s", 1, 0), ("n_se", 1, 1)]
_NAMES = [n for n, _, _ in DIRECTIONS]
PERIODS = (2, 5, 10, 25, 50, 100, 500)


def d8_direction(cells: DataFrame, z: str = "z", weighted: bool = True) -> DataFrame:
    """cells with direction: the code of the neighbour of steepest descent, the first of ties, -1 without one."""
    step = nbr3x3(cells, z, replicate=False)
    drops = [F.struct(((F.col(z) - F.col(n)) / (1.414 if weighted and dr and dc else 1.0)).alias("d"), F.lit(-i).alias("i")) for i, (n, dr, dc) in enumerate(DIRECTIONS)]
    best = F.array_max(F.filter(F.array(*drops), lambda x: x["d"] > 0))
    return step.withColumn("direction", F.coalesce(-best["i"], F.lit(-1))).drop(*_NAMES)


def flow_edges(directed: DataFrame) -> DataFrame:
    """(row, col, row2, col2) of every cell that drains."""
    pick = lambda k: F.element_at(F.array(*(F.lit(d[k]) for d in DIRECTIONS)), F.col("direction") + 1)
    return directed.where("direction >= 0").select("row", "col", (F.col("row") + pick(1)).alias("row2"), (F.col("col") + pick(2)).alias("col2"))


def flow_accumulation(directed: DataFrame) -> DataFrame:
    """directed with accumulation: the number of cells that drain through each, itself included.

    Doubling: each round, every cell's count is passed on to the cell that its pointer names, and
    pointers jump twice as far; rounds are the logarithm of the longest path.
    """
    base = directed.select("row", "col").withColumn("acc", F.lit(1).cast("long"))
    acc, jump = stored(base, "acc"), stored(flow_edges(directed), "jump")
    while True:
        passed = acc.join(jump, ["row", "col"]).groupBy(F.col("row2").alias("row"), F.col("col2").alias("col")).agg(F.sum("acc").alias("more"))
        more = stored(acc.join(passed, ["row", "col"], "left").select("row", "col", (F.col("acc") + F.coalesce("more", F.lit(0))).alias("acc")), "acc")
        onward = jump.select(F.col("row").alias("row2"), F.col("col").alias("col2"), F.col("row2").alias("row3"), F.col("col2").alias("col3"))
        far = stored(jump.join(onward, ["row2", "col2"]).select("row", "col", F.col("row3").alias("row2"), F.col("col3").alias("col2")), "jump")
        discard(acc, jump)
        acc, jump = more, far
        if jump.isEmpty():
            break
    return directed.join(acc.withColumnRenamed("acc", "accumulation"), ["row", "col"])


def stream_cells(threshold: int = 1000) -> Column:
    return F.col("accumulation") > threshold


def distance_to_stream(cells: DataFrame, stream: Column, res: float) -> DataFrame:
    """cells with distance_to_stream_m, null without any stream."""
    return nearest_where(cells, stream, []).withColumn("distance_to_stream_m", F.sqrt("near_d2") * res).drop("near_d2")


def hand(cells: DataFrame, stream: Column, z: str = "z") -> DataFrame:
    """cells with hand_m: height above the first stream cell downstream, 0 at least.

    Pointers jump until they rest on a stream cell. Cells that reach none have the largest height of
    the rest, 100 if there are none.
    """
    marked = stored(cells.withColumn("_stream", stream), "marked")
    onward = flow_edges(marked.where("not _stream")).unionByName(marked.where("_stream").select("row", "col", F.col("row").alias("row2"), F.col("col").alias("col2")))
    jump = stored(onward, "jump")
    while True:
        nxt = jump.select(F.col("row").alias("row2"), F.col("col").alias("col2"), F.col("row2").alias("row3"), F.col("col2").alias("col3"))
        new = stored(jump.join(nxt, ["row2", "col2"], "left").select("row", "col", F.coalesce("row3", "row2").alias("row2"), F.coalesce("col3", "col2").alias("col2"), (F.col("row3").isNotNull() & ((F.col("row3") != F.col("row2")) | (F.col("col3") != F.col("col2")))).cast("int").alias("moved")), "jump")
        discard(jump)
        jump = new
        if jump.where("moved = 1").isEmpty():
            break
    ends = marked.where("_stream").select(F.col("row").alias("row2"), F.col("col").alias("col2"), F.col(z).alias("_z2"))
    found = marked.join(jump.drop("moved"), ["row", "col"], "left").join(ends, ["row2", "col2"], "left").withColumn("_h", F.when(F.col("_z2").isNotNull(), F.greatest(F.col(z) - F.col("_z2"), F.lit(0.0))))
    most_ = found.agg(F.coalesce(F.max("_h"), F.lit(100.0)).alias("_most"))
    return found.crossJoin(F.broadcast(most_)).withColumn("hand_m", F.coalesce("_h", "_most")).drop("row2", "col2", "_z2", "_h", "_most", "_stream")


def flow_features(cells: DataFrame, res: float, threshold: int = 1000, z: str = "z", eps: float = 1e-4) -> DataFrame:
    """Direction, accumulation, stream, distance, height above it and wetness as one layer; cells has slope_deg.

    Flow runs over the filled surface, and heights are the filled ones. With an ``eps`` every cell drains; with 0,
    filled depressions are flat and flow ends in them.
    """
    filled = fill_depressions(cells, z, eps)
    layer = flow_accumulation(d8_direction(filled, "filled")).withColumn("stream", stream_cells(threshold))
    layer = hand(distance_to_stream(layer, F.col("stream"), res), F.col("stream"), "filled").drop("filled")
    return layer.withColumn("cti", wetness(F.col("accumulation"), F.col("slope_deg"), res))


# --- floods -----------------------------------------------------------------------------------


def peak_flow(areas: DataFrame, regression: DataFrame, periods: tuple[int, ...] = PERIODS) -> DataFrame:
    """areas (cells) with peak flow (m3/s) for each return period."""
    mi2 = F.col("cells") * 100 / 1609.34**2
    each = areas.withColumn("period", F.explode(F.array(*(F.lit(p) for p in periods)))).join(F.broadcast(regression), "period", "left")
    return each.withColumn("q_m3s", F.coalesce("a", F.lit(500.0)) * F.pow(mi2, F.coalesce("b", F.lit(0.72))) * 0.0283168).drop("a", "b")


def manning_depth(q: Column, width: Column | float, roughness: Column | float = 0.05, slope: float = 0.005) -> Column:
    w, n = F.lit(width) if not isinstance(width, Column) else width, F.lit(roughness) if not isinstance(roughness, Column) else roughness
    return F.when((q <= 0) | (w <= 0), 0.0).otherwise(F.pow(q * n / (w * slope**0.5), F.lit(0.6)))


def inundation_depth(cells: DataFrame, rises: DataFrame) -> DataFrame:
    """cells (hand_m) x rises (period, rise): depth, null where dry."""
    d = F.col("rise") - F.col("hand_m")
    return cells.crossJoin(F.broadcast(rises)).withColumn("depth", F.when(d > 0, d))


def flooded_area(depths: DataFrame, res: float) -> DataFrame:
    return depths.groupBy("period").agg(F.count("depth").alias("cells"), (F.count("depth") * (res * res / 1e4)).alias("hectares"))


def parcel_flood_depths(places: DataFrame, depths: DataFrame, periods: tuple[int, ...] = (10, 25, 100)) -> DataFrame:
    """places (parcel_id, row, col) with a depth for each period, 0 where dry."""
    met = places.join(depths.where(F.col("period").isin(*periods)).select("row", "col", "period", "depth"), ["row", "col"], "left")
    wide = met.groupBy("parcel_id").pivot("period", list(periods)).agg(F.first("depth"))
    return wide.select("parcel_id", *(F.coalesce(f"`{p}`", F.lit(0.0)).alias(f"depth_{p}yr") for p in periods))


def flood_points() -> Column:
    d = {p: F.coalesce(f"depth_{p}yr", F.lit(0.0)) for p in (10, 25, 100)}
    points = F.when(d[100] > 0, 30 + F.least(10 * d[100], F.lit(20.0))).otherwise(0.0) + F.when(d[25] > 0, 25).otherwise(0) + F.when(d[10] > 0, 25).otherwise(0)
    return F.least(points, F.lit(100.0))


def roughness_by_cover(df: DataFrame, table: DataFrame, default: float = 0.05) -> DataFrame:
    return df.join(F.broadcast(table.withColumnRenamed("n", "roughness")), "cover", "left").withColumn("roughness", F.coalesce("roughness", F.lit(default)))
