"""Terrain of cells: slope, aspect, position, ruggedness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from perilframe.operators.grid import box_mean, nbr3x3


def _gradient(value: str, window, res: float) -> Column:
    """Central differences, one-sided at the edges."""
    before, after = F.lag(value).over(window), F.lead(value).over(window)
    own = F.col(value)
    return F.when(before.isNull() & after.isNull(), F.lit(0.0)).when(before.isNull(), after - own).when(after.isNull(), own - before).otherwise((after - before) / 2) / res


def slope_aspect(cells: DataFrame, res: float, z: str = "z") -> DataFrame:
    """cells with slope_deg and aspect_deg, the bearing of the uphill gradient."""
    step = cells.withColumn("_dx", _gradient(z, Window.partitionBy("row").orderBy("col"), res))
    step = step.withColumn("_dy", -_gradient(z, Window.partitionBy("col").orderBy("row"), res))
    slope = F.degrees(F.atan(F.hypot("_dx", "_dy")))
    return step.withColumn("slope_deg", slope).withColumn("aspect_deg", F.pmod(F.degrees(F.atan2("_dx", "_dy")) + 360, F.lit(360.0))).drop("_dx", "_dy")


def northness(aspect: Column) -> Column:
    return F.cos(F.radians(aspect))


def eastness(aspect: Column) -> Column:
    return F.sin(F.radians(aspect))


def tpi(cells: DataFrame, res: float, reach_m: float = 300.0, z: str = "z") -> DataFrame:
    k = max(1, int(reach_m / res))
    return box_mean(cells, z, k, "_mean").withColumn("tpi", F.col(z) - F.col("_mean")).drop("_mean")


def tpi_class(cells: DataFrame) -> DataFrame:
    """cells with tpi_class, by the layer's standard deviation."""
    sd = cells.agg(F.stddev_pop("tpi").alias("_sd"))
    t, s = F.col("tpi"), F.col("_sd")
    kind = F.when(t > s, "ridge").when(t > 0.5 * s, "upper_slope").when(t > -0.5 * s, "mid_slope").otherwise("valley")
    return cells.crossJoin(F.broadcast(sd)).withColumn("tpi_class", kind).drop("_sd")


def tri(cells: DataFrame, z: str = "z") -> DataFrame:
    names = ["n_nw", "n_n", "n_ne", "n_w", "n_e", "n_sw", "n_s", "n_se"]
    squares = [F.pow(F.col(n) - F.col(z), 2) for n in names]
    return nbr3x3(cells, z).withColumn("tri", F.sqrt(sum(squares[1:], squares[0]))).drop(*names)


def heat_load(slope: Column, aspect: Column) -> Column:
    x = (1 - F.cos(F.radians(aspect - 45))) / 2 * F.sin(F.radians(slope))
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


def wetness(accumulation: Column, slope: Column, res: float) -> Column:
    x = F.ln(accumulation * (res * res) / F.tan(F.radians(F.greatest(slope, F.lit(0.001)))))
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(30.0))


def upslope_profile(places: DataFrame, cells: DataFrame, res: float, buffers: tuple[int, ...] = (100, 300, 500), direction: str = "uphill") -> DataFrame:
    """(id, upslope_profile_*m): the mean slope of the cells stepped over from each place's cell.

    places has (id, row, col); steps go uphill, or along aspect + 180 if ``direction`` is 'as_coded'.
    """
    n = int(max(buffers) / res)
    bearing = F.radians(F.col("aspect_deg") + (180 if direction == "as_coded" else 0))
    start = places.select("id", "row", "col").join(cells.select("row", "col", "aspect_deg"), ["row", "col"])
    steps = start.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(n))))
    row = (F.col("row") - F.floor(F.col("step") * F.cos(bearing) + 0.5)).cast("int")
    col = (F.col("col") + F.floor(F.col("step") * F.sin(bearing) + 0.5)).cast("int")
    met = steps.select("id", "step", row.alias("row"), col.alias("col")).join(cells.select("row", "col", "slope_deg"), ["row", "col"])
    means = met.groupBy("id").agg(*(F.avg(F.when(F.col("step") <= int(b / res), F.col("slope_deg"))).alias(f"upslope_profile_{b}m") for b in buffers))
    out = places.select("id").join(means, "id", "left")
    return out.select("id", *(F.coalesce(f"upslope_profile_{b}m", F.lit(0.0)).alias(f"upslope_profile_{b}m") for b in buffers))


def terrain_features(cells: DataFrame, res: float, z: str = "z") -> DataFrame:
    """Everything above as one layer; all windows share the two partitionings by row and by column."""
    out = tri(tpi(slope_aspect(cells, res, z), res, z=z), z)
    aspect = F.col("aspect_deg")
    return tpi_class(out.withColumns({"northness": northness(aspect), "eastness": eastness(aspect), "heat_load_index": heat_load(F.col("slope_deg"), aspect)}))
