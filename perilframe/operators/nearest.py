"""Nearest other polygon, by bounds from a space-filling curve and a grid of many widths."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from perilframe.functions import geometry as geo
from perilframe.operators.iterate import discard, stored

#: Bits of a coordinate along the curve, and neighbours along it that each site is measured to on either side.
BITS, BESIDE = 21, 3
#: Grid levels are powers of two of a metre; the least one.
FINEST = -3


def interleaved(x: Column, y: Column) -> Column:
    """The bits of two longs of ``BITS`` bits, in turns: places that are near on the curve are near on the ground."""

    def spread(v: Column) -> Column:
        for by, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
            v = v.bitwiseOR(F.shiftleft(v, by)).bitwiseAND(F.lit(mask))
        return v

    return spread(x.cast("long")).bitwiseOR(F.shiftleft(spread(y.cast("long")), 1))


def _beside(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows in the curve's order with u, the distance of corner (px, py) to the nearest of those beside it."""
    tail = np.empty((0, 2))
    for frame in frames:
        at = np.concatenate((tail, frame[["px", "py"]].to_numpy(float)))
        least = np.full(len(at), np.inf)
        for k in range(1, min(BESIDE, len(at) - 1) + 1):
            d = np.hypot(*(at[k:] - at[:-k]).T)
            least[k:], least[:-k] = np.minimum(least[k:], d), np.minimum(least[:-k], d)
        yield frame.drop(columns=["px", "py"]).assign(u=least[len(tail) :])
        tail = at[-BESIDE:]


def bounded(sites: DataFrame) -> DataFrame:
    """sites (id, px, py, x0, y0, x1, y1) with u: no less than the distance to the nearest other one, and near it where the curve keeps neighbours together.

    Sites are put in order along the curve by range partitions, once as they lie and once moved by a third. Those
    beside each other are measured, within a partition, so a bound that the cut makes is loose but right.
    """
    e = sites.agg(F.min("px").alias("x"), F.min("py").alias("y"), F.greatest(F.max("px") - F.min("px"), F.max("py") - F.min("py")).alias("size")).first()
    if e["size"] is None:
        return sites.drop("px", "py").withColumn("u", F.lit(None).cast("double"))
    unit = 2 * max(e["size"], 1e-6) / (2**BITS - 1)
    schema = "id long, x0 double, y0 double, x1 double, y1 double, u double"
    ways = []
    for shift in (0.0, e["size"] / 3):
        code = interleaved(F.floor((F.col("px") - e["x"] + shift) / unit), F.floor((F.col("py") - e["y"] + shift) / unit))
        order = sites.withColumn("_at", code).repartitionByRange("_at").sortWithinPartitions("_at").select("id", "x0", "y0", "x1", "y1", "px", "py")
        ways.append(order.mapInPandas(_beside, schema))
    widest = F.lit(1.5 * e["size"])
    return ways[0].unionByName(ways[1]).groupBy("id", "x0", "y0", "x1", "y1").agg((F.least(F.min("u"), widest) * (1 + 1e-9) + 1e-6).alias("u"))


def _level(width: Column, height: Column) -> Column:
    return F.greatest(F.ceil(F.log2(F.greatest(width, height, F.lit(2.0**FINEST)))), F.lit(FINEST)).cast("int")


def _dealt(boxes: DataFrame, levels: list[int]) -> DataFrame:
    """boxes (.., level, x0, y0, x1, y1) in the cells that they meet, four at most, of their own level and of every coarser one of ``levels``."""
    own = F.array_distinct(F.concat(F.array("level"), F.filter(F.array(*(F.lit(v) for v in levels)), lambda v: v > F.col("level"))))
    at = boxes.withColumn("_l", F.explode(own)).withColumn("_w", F.pow(F.lit(2.0), F.col("_l")))
    cells = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / F.col("_w")), F.floor(F.col(b) / F.col("_w"))))
    return at.withColumn("_ix", cells("x0", "x1")).withColumn("_iy", cells("y0", "y1")).drop("_w")


def candidates(known: DataFrame) -> DataFrame:
    """(a, b), each pair of ids once: b's box is no farther from a's than u of a, or the other way round.

    A box, and a box widened by its u, lie in a grid whose cells are as wide as they are. Two of them meet in
    the coarser one's grid, so a huge footprint widens nobody else's search, and cells are small where sites are dense.
    """
    wide = known.select("id", "u", *((F.col(c) + s * F.col("u")).alias(c) for c, s in (("x0", -1), ("y0", -1), ("x1", 1), ("y1", 1))))
    wide = wide.withColumn("level", _level(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")))
    plain = known.select("id", "x0", "y0", "x1", "y1").withColumn("level", _level(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")))
    # Levels are exponents of two, so there are a few dozen of them at most.
    of = lambda df: sorted(r["level"] for r in df.select("level").distinct().collect())
    one = _dealt(wide, of(plain)).alias("q")
    two = _dealt(plain, of(wide)).select(*(F.col(c).alias(f"{c}_2") for c in ("id", "x0", "y0", "x1", "y1", "level")), "_l", "_ix", "_iy")
    gap = lambda k: F.greatest(F.lit(0.0), F.col(f"{k}0") + F.col("u") - F.col(f"{k}1_2"), F.col(f"{k}0_2") - F.col(f"{k}1") + F.col("u"))
    met = one.join(two, ["_l", "_ix", "_iy"]).where((F.col("id") != F.col("id_2")) & (F.col("_l") == F.greatest("level", "level_2")) & (F.hypot(gap("x"), gap("y")) <= F.col("u")))
    return met.select(F.least("id", "id_2").alias("a"), F.greatest("id", "id_2").alias("b")).distinct()


def nearest_other(shapes: DataFrame) -> DataFrame:
    """shapes (id long, rings) to (id, d): the distance of each polygon to the nearest other one; no row for one alone or without corners."""
    corners = shapes.select("id", F.flatten("rings").alias("corners"), geo.all_sides(F.col("rings")).alias("sides"), geo.polygon_box(F.col("rings")).alias("b"))
    corner = F.get("corners", F.lit(0))
    sites = corners.select("id", corner["x"].alias("px"), corner["y"].alias("py"), "b.*").where("px is not null and py is not null")
    known = stored(bounded(sites).where("u is not null"), "bounds")
    shape = lambda k: corners.select(F.col("id").alias(k), F.col("corners").alias(f"{k}_c"), F.col("sides").alias(f"{k}_s"))
    met = candidates(known).join(shape("a"), "a").join(shape("b"), "b")
    d = geo.outline_distance(F.col("a_c"), F.col("a_s"), F.col("b_c"), F.col("b_s"))
    both = met.select(d.alias("d"), F.explode(F.array("a", "b")).alias("id"))
    out = stored(both.groupBy("id").agg(F.min("d").alias("d")), "nearest")
    discard(known)
    return out
