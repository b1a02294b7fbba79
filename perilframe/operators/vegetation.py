"""Vegetation and fuel of cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from perilframe.functions import geometry as geo
from perilframe import dims

_EPS = 1e-6
#: Rows of the unmixing matrix on (r, g, b, nir).
UNMIX = (
    (-4.818571, 32.409286, -29.330629, -1.185486),
    (-24.611224, 212.305612, -184.279919, -23.968898),
    (20.306513, -160.153257, 141.37931, 17.624521),
)
PARAMETERS = ["w1", "w10", "w100", "lh", "lw", "delta", "mx", "sigma", "h"]


def _clip(x: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(x, F.lit(float(lo))), F.lit(float(hi)))


def scaled_bands(pixels: DataFrame) -> DataFrame:
    """Bytes to shares: r, g, b, nir."""
    return pixels.select("row", "col", *((F.col(c) / 255.0).alias(n) for c, n in (("red", "r"), ("green", "g"), ("blue", "b"), ("nir", "nir"))), "red")


def ndvi() -> Column:
    return _clip((F.col("nir") - F.col("r")) / (F.col("nir") + F.col("r") + _EPS), -1, 1)


def ndwi() -> Column:
    return _clip((F.col("g") - F.col("nir")) / (F.col("g") + F.col("nir") + _EPS), -1, 1)


def evi() -> Column:
    return _clip(2.5 * (F.col("nir") - F.col("r")) / (F.col("nir") + 6 * F.col("r") - 7.5 * F.col("b") + 1 + _EPS), -1, 5)


def unmix(df: DataFrame) -> DataFrame:
    """df with the shares gv, npv and soil."""
    raw = [_clip(sum(F.lit(w) * F.col(c) for w, c in zip(row, ("r", "g", "b", "nir"))), 0, 1) for row in UNMIX]
    step = df.withColumns({f"_{n}": x for n, x in zip(("gv", "npv", "soil"), raw)})
    total = F.col("_gv") + F.col("_npv") + F.col("_soil") + _EPS
    return step.withColumns({n: F.col(f"_{n}") / total for n in ("gv", "npv", "soil")}).drop("_gv", "_npv", "_soil")


def flammability_class(v: Column, w: Column) -> Column:
    """0 to 4; the rules that come first here override the later ones."""
    return F.when(v < 0.05, 0).when((v <= 0.1) & (w < -0.2), 4).when((v > 0.1) & (v <= 0.3) & (w < 0), 3).when((v > 0.3) & (v <= 0.5), 2).when(v > 0.5, 1).otherwise(0)


def zonal_veg_stats(places: DataFrame, cells: DataFrame, res: float, x0: float, y0: float) -> DataFrame:
    """Statistics of the cells whose centre lies in each place's polygon (parcel_id, rings), or box (parcel_id, cx, cy, half); none: null.

    Cells with red 0 are invalid. A place is dealt to the tiles that its box meets, so the join is by
    tile, and the box or polygon is checked after it.
    """
    tile = 16 * res
    x, y = F.lit(x0) + (F.col("col") + 0.5) * res, F.lit(y0) - (F.col("row") + 0.5) * res
    spots = cells.where("red <> 0").withColumn("_x", x).withColumn("_y", y).withColumn("_tx", F.floor(F.col("_x") / tile)).withColumn("_ty", F.floor(F.col("_y") / tile))
    side = lambda c, k: F.struct((F.col(c) - F.col("half")).alias(f"{k}0"), (F.col(c) + F.col("half")).alias(f"{k}1"))
    whole = "rings" in places.columns
    box = geo.polygon_box(F.col("rings")) if whole else F.struct(*(side(c, k)[f"{k}{e}"].alias(f"{k}{e}") for c, k in (("cx", "x"), ("cy", "y")) for e in (0, 1)))
    span = lambda k: F.sequence(F.floor(F.col(f"_box.{k}0") / tile), F.floor(F.col(f"_box.{k}1") / tile))
    boxes = places.select("parcel_id", *(["rings"] if whole else []), box.alias("_box")).withColumn("_tx", F.explode(span("x"))).withColumn("_ty", F.explode(span("y")))
    met = boxes.join(spots, ["_tx", "_ty"]).where("_x between _box.x0 and _box.x1 and _y between _box.y0 and _box.y1")
    if whole:
        met = met.where(geo.polygon_contains(F.col("rings"), F.col("_x"), F.col("_y")))
    stats = met.groupBy("parcel_id").agg(
        F.avg("ndvi").alias("ndvi_mean"), F.percentile("ndvi", F.lit(0.9)).alias("ndvi_p90"), F.stddev_pop("ndvi").alias("ndvi_std"), F.avg("ndwi").alias("ndwi_mean"), F.avg("evi").alias("evi_mean"),
        F.avg("npv").alias("dry_veg_fraction_mean"), (100 * F.avg((F.col("ndvi") > 0.4).cast("double"))).alias("canopy_cover_pct"),
    )
    return places.select("parcel_id").join(stats, "parcel_id", "left")


def map_fuel_models(cells: DataFrame, models: DataFrame, code: str = "fbfm40") -> DataFrame:
    """cells with their fuel model and its parameters; unknown codes are NB9, with zeros."""
    known = models.withColumnRenamed("code", code)
    out = cells.join(F.broadcast(known), code, "left")
    return out.withColumn("model", F.coalesce("model", F.lit("NB9"))).withColumns({p: F.coalesce(p, F.lit(0.0)) for p in PARAMETERS})


def fuel_params(names: DataFrame, models: DataFrame) -> DataFrame:
    """names (name) with the parameters of the model so called, in any case; those of NB9 for others."""
    known = models.drop("code")
    other = models.where("model = 'NB9'").select(*(F.col(p).alias(f"_{p}") for p in PARAMETERS))
    out = names.join(F.broadcast(known), F.upper("name") == F.col("model"), "left").crossJoin(F.broadcast(other))
    return out.select("name", F.coalesce("model", F.lit("NB9")).alias("model"), *(F.coalesce(p, f"_{p}").alias(p) for p in PARAMETERS))


def total_fuel_load() -> Column:
    return F.col("w1") + F.col("w10") + F.col("w100") + F.col("lh") + F.col("lw")


def ladder_fuel() -> Column:
    return F.col("model").isin(dims.LADDER_CELLS) & (F.col("canopy_height") > 2) & (F.col("canopy_base") > 2)


def fuel_summary(mapped: DataFrame) -> DataFrame:
    burnable = ~F.col("model").isin("NB1", "NB9")
    return mapped.agg(F.count_distinct("model").alias("models"), F.count_if(burnable).alias("burnable_cells"), (100.0 * F.count_if(burnable) / F.count(F.lit(1))).alias("burnable_pct"))


def dominant_burnable_code(mapped: DataFrame, models: DataFrame, default: int = 161) -> DataFrame:
    """The code of the first burnable model present."""
    first = mapped.where(~F.col("model").isin("NB1", "NB9")).agg(F.min("model").alias("model"))
    return first.join(F.broadcast(models.select("model", "code")), "model", "left").select(F.coalesce("model", F.lit("none")).alias("model"), F.coalesce("code", F.lit(default)).alias("code"))


def fuel_coverage(mapped: DataFrame, zone: Column) -> DataFrame:
    """(zone, fuel_models): the share of each code in a zone, as a map."""
    n = mapped.groupBy(zone.alias("zone"), "fbfm40").agg(F.count(F.lit(1)).alias("n"))
    total = n.groupBy("zone").agg(F.sum("n").alias("total"))
    pairs = n.join(total, "zone").groupBy("zone").agg(F.array_sort(F.collect_list(F.struct(F.col("fbfm40").cast("string").alias("k"), (F.col("n") / F.col("total")).alias("v")))).alias("e"))
    return pairs.select("zone", F.map_from_entries("e").alias("fuel_models"))
