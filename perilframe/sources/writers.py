"""Writing layers, property rows and exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from perilframe.functions import geometry as geo


def write_cells(df: DataFrame, path: str, tile: int = 256) -> None:
    """Parquet, a folder for each tile of cells; values as floats, no data as null."""
    floats = [F.col(c).cast("float").alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]
    df.select(*floats).withColumn("tile", F.concat_ws("_", F.floor(F.col("row") / tile), F.floor(F.col("col") / tile))).repartition("tile").write.mode("overwrite").partitionBy("tile").parquet(path)


def write_weather(df: DataFrame, path: str) -> None:
    df.withColumn("year", F.year("date")).repartition("year").write.mode("overwrite").partitionBy("year").parquet(path)


def write_wind_rose(rose: DataFrame, path: str) -> None:
    """A rose (sector, center_deg, frequency, p90, p95, p99) as one JSON document, a list for each measure in order of sectors."""
    names = {"center_deg": "sectors", "frequency": "frequency", "p90": "pct_90", "p95": "pct_95", "p99": "pct_99"}
    row = rose.agg(F.array_sort(F.collect_list(F.struct("sector", *names))).alias("all"))  # as many as a rose has sectors
    row.select(*(F.col(f"all.{c}").alias(n) for c, n in names.items())).coalesce(1).write.mode("overwrite").json(path)


def stats_document(scored: DataFrame, arrivals: DataFrame, score: str = "wildfire_risk_score") -> DataFrame:
    """One row: what an export says of all buildings (scores to one decimal, 0 without any) and of the cells a fire reached (toa, in minutes)."""
    s = F.col(score)
    one = lambda c: F.coalesce(F.round(F.round(c, 9), 1), F.lit(0.0))
    buildings = scored.agg(
        F.count(F.lit(1)).alias("buildingCount"), one(F.avg(s)).alias("meanRisk"), one(F.max(s)).alias("maxRisk"), one(F.min(s)).alias("minRisk"),
        F.count_if(s >= 55).alias("highRiskCount"), F.count_if((s >= 30) & (s < 55)).alias("moderateRiskCount"), F.count_if(s < 30).alias("lowRiskCount"),
    )
    fire = arrivals.agg(one(F.max("toa")).alias("fireMaxArrival"), F.count("toa").alias("fireBurnedCells"))
    return buildings.crossJoin(F.broadcast(fire))  # one row each


def export_stats(scored: DataFrame, arrivals: DataFrame, path: str) -> None:
    stats_document(scored, arrivals).coalesce(1).write.mode("overwrite").json(path)


def write_twins(df: DataFrame, path: str) -> None:
    df.repartition("county").write.mode("overwrite").partitionBy("county").parquet(path)


def feature(ring: Column, properties: list[Column]) -> Column:
    """A GeoJSON feature as text; null without a ring."""
    points = F.transform(ring, lambda p: F.array(p["x"], p["y"]))
    closed = F.array(F.concat(points, F.slice(points, 1, 1)))
    geometry = F.struct(F.lit("Polygon").alias("type"), closed.alias("coordinates"))
    return F.when(ring.isNotNull(), F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct(*properties).alias("properties")), {"ignoreNullFields": "false"}))


def export_features(df: DataFrame, path: str, properties: list[str], ring: str = "ring") -> None:
    """One feature a line."""
    df.select(feature(F.col(ring), [F.col(p) for p in properties]).alias("value")).where("value is not null").write.mode("overwrite").text(path)


#: The fields of an exported building beside its scores: name there, column here, decimals.
BUILDING_FIELDS = [
    ("slope", "slope_degrees", 1), ("aspect", "aspect_degrees", 1), ("heatLoadIndex", "heat_load_index", 3), ("tpiClass", "tpi_class", None), ("stories", "stories", None), ("buildingSqFt", "building_sf", 0),
    ("canopyCover", "canopy_cover_pct", 1), ("ndviMean", "ndvi_mean", 3), ("ladderFuel", "ladder_fuel_present", None), ("fireArrivalMin", "fire_arrival_min", 1), ("emberProbability", "ember_exposure_probability", 3), ("ownerFlagged", "is_owner_flagged", None),
]
PART_LIMITS = {"terrain": 25, "vegetation": 30, "structure": 35, "exposure": 10}


def building_properties(df: DataFrame, parts: dict[str, Column], category: Column) -> list[Column]:
    """What an exported building says of itself; columns that df lacks are null."""
    has = lambda c: F.col(c) if c in df.columns else F.lit(None).cast("double")
    words = lambda c: F.initcap(F.replace(has(c).cast("string"), F.lit("_"), F.lit(" ")))
    out = [F.col("parcel_id").alias("id"), F.nullif("name", F.lit("")).alias("name"), F.nullif("address", F.lit("")).alias("address"), F.round(F.round("wildfire_risk_score", 9), 1).alias("riskScore"), category.alias("riskCategory")]
    for name, most in PART_LIMITS.items():
        out += [F.round(F.round(parts[name], 9), 1).alias(name), F.lit(most).alias(f"{name}Max")]
    out += [words("roof_material").alias("roofMaterial"), words("vent_screening_status").alias("ventScreening"), F.when(has("year_built") > 0, has("year_built").cast("int")).alias("yearBuilt")]
    return out + [(has(c) if places is None else F.round(has(c), places)).alias(name) for name, c, places in BUILDING_FIELDS]


def degrees(ring: Column) -> Column:
    """A ring in metres as (longitude, latitude)."""
    def turned(p: Column) -> Column:
        lon, lat = geo.from_utm(p["x"], p["y"])
        return F.struct(lon.alias("x"), lat.alias("y"))

    return F.transform(ring, turned)


def line_feature(points: Column, minutes: Column) -> Column:
    """An isochrone's points (x, y) as a GeoJSON feature."""
    label = F.when(minutes >= 1, F.concat(F.regexp_replace(minutes.cast("string"), r"\.0$", ""), F.lit(" min"))).otherwise(F.concat((minutes * 60).cast("int").cast("string"), F.lit(" sec")))
    geometry = F.struct(F.lit("LineString").alias("type"), F.transform(points, lambda p: F.array(p["x"], p["y"])).alias("coordinates"))
    return F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct(minutes.alias("minutes"), label.alias("label")).alias("properties")))


def export_isochrones(lines: DataFrame, path: str) -> None:
    """lines (level, points in degrees), one feature a line."""
    lines.select(line_feature(F.col("points"), F.col("level")).alias("value")).write.mode("overwrite").text(path)


def write_param_layers(mapped: DataFrame, path: str, parameters: list[str]) -> None:
    """Fuel parameters of every cell as floats, a column for each band."""
    write_cells(mapped.select("row", "col", *(F.col(p).cast("double").alias(p) for p in parameters)), path)


def write_twin_documents(df: DataFrame, path: str) -> None:
    """One JSON document a line, with every field, null ones too."""
    df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)


def arrival_sample(cells: DataFrame, step: int) -> DataFrame:
    """Every step-th reached cell with intensity."""
    return cells.where((F.col("row") % step == 0) & (F.col("col") % step == 0) & F.col("toa").isNotNull() & (F.col("intensity") > 0))


def cached_step(spark: SparkSession, path: str, build, refresh: bool = False) -> DataFrame:
    """The table at a path, built and written only if it isn't complete there."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")
    done = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)
    if refresh or not done:
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def step_status(spark: SparkSession, steps: dict) -> DataFrame:
    """Run steps (name: function giving a DataFrame) and report each; one that fails doesn't stop the next."""
    import time

    rows = []
    for name, build in steps.items():
        began = time.time()
        try:
            rows.append((name, True, int(build().count()), time.time() - began, None))
        except Exception as e:  # noqa: BLE001  reported, not hidden
            rows.append((name, False, None, time.time() - began, str(e)[:500]))
    return spark.createDataFrame(rows, "step string, ok boolean, rows long, seconds double, error string")
