"""Queries of sources and sinks over the given tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from perilframe.functions import geometry as geo
from perilframe.operators.iterate import shared_path
from perilframe.operators.scoring import components, risk_category
from perilframe.operators.weather import wind_rose
from perilframe.plans.cell_queries import _ROSE, _SECTOR
from perilframe.plans.hazard_queries import _LINES, isochrones
from perilframe.plans.registry import query
from perilframe.plans.risk_queries import _CATEGORY, _W, TERRAIN, scored
from perilframe.sources import readers as R
from perilframe.sources import writers as K


@query("src1_read_points", "SELECT tile, count(*) AS n, round(sum(x), 3) AS sx, round(sum(z), 3) AS sz, CAST(sum(intensity) AS BIGINT) AS intensity, count(*) FILTER (classification = 2) AS ground FROM points GROUP BY 1")
def _(i):
    path = shared_path(i.spark, "points")
    i.points.write.parquet(path)
    read = R.read_points(i.spark, path)
    return read.groupBy("tile").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("x"), 3).alias("sx"), F.round(F.sum("z"), 3).alias("sz"), F.sum("intensity").alias("intensity"), F.count_if(F.col("classification") == 2).alias("ground"))


@query("src4_not_yet", "SELECT l_orderkey * 10 + l_linenumber AS filename, l_returnflag AS url FROM lineitem WHERE l_returnflag <> 'A' AND l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 3 = 0)")
def _(i):
    name = (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("filename")
    index = i.lineitem.select(name, F.when(F.col("l_returnflag") != "A", F.col("l_returnflag")).alias("url"), F.lit(None).cast("string").alias("download_url"))
    have = i.lineitem.join(i.orders.where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_semi").select(name)
    return R.not_yet(index, have).select("filename", "url")


@query("src5_read_dem_cells", "SELECT row, col, round(CASE WHEN (row + col) % 9 = 0 THEN NULL ELSE z END, 9) AS z FROM cells", 9)
def _(i):
    raw = F.when((F.col("row") + F.col("col")) % 9 == 0, F.lit(-9999.0)).otherwise(F.col("z"))
    return i.cells.select("row", "col", R.no_sentinel(raw).alias("z"))


@query("src6_read_band_cells", "SELECT row, col, round(red / 255.0::DOUBLE, 6) AS r, round(nir / 255.0::DOUBLE, 6) AS nir FROM pixels")
def _(i):
    from perilframe.operators.vegetation import scaled_bands

    return scaled_bands(i.pixels).select("row", "col", "r", "nir")


@query("src8_read_weather_records", "SELECT CAST(station AS VARCHAR) AS station, datatype, count(*) AS n, sum(value) AS total, CAST(min(date) AS VARCHAR) AS since, max(seq) AS last FROM weather_long GROUP BY 1, 2")
def _(i):
    """Records written as pages, each a JSON array of at most a thousand, and read back."""
    path = shared_path(i.spark, "pages")
    records = F.collect_list(F.struct(F.col("station").cast("string").alias("station"), F.col("date").cast("string").alias("date"), "datatype", "value", "seq"))
    i.weather_long.groupBy(F.floor(F.col("seq") / 1000).alias("page")).agg(F.to_json(records).alias("value")).select("value").write.text(path)
    read = R.read_records(i.spark, path, lines=True)
    return read.groupBy("station", "datatype").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"), F.min("date").alias("since"), F.max("seq").alias("last"))


_PATCHES = "SELECT concat('patches/', CASE WHEN CAST(parcel_id AS INT) % 9 = 0 THEN 'unsorted' ELSE roof_material END, '/', parcel_id, '.npy') AS path FROM properties"


@query("src17_labelled_classes", f"WITH p AS ({_PATCHES}), f AS (SELECT class_id, count(*) AS n FROM p JOIN roof_classes c ON c.label = split_part(path, '/', 2) GROUP BY 1) SELECT c.class_id, c.label, coalesce(f.n, 0) AS files FROM roof_classes c LEFT JOIN f ON f.class_id = c.class_id")
def _(i):
    """How many patches each class has, of the paths of all properties' patches."""
    folder = F.when(F.col("parcel_id").cast("int") % 9 == 0, F.lit("unsorted")).otherwise(F.col("roof_material"))
    paths = i.properties.select(F.concat(F.lit("patches/"), folder, F.lit("/"), "parcel_id", F.lit(".npy")).alias("path"))
    return R.class_counts(paths.withColumn("label", R.label_of(F.col("path"))), i.roof_classes)


@query("snk2_write_wind_rose", f"""{_ROSE}, s AS (SELECT {_SECTOR} AS sector, * FROM w), g AS (SELECT sector, count(*) AS n, quantile_cont(wind_speed_mph, 0.9) AS p90, quantile_cont(wind_speed_mph, 0.95) AS p95, quantile_cont(wind_speed_mph, 0.99) AS p99 FROM s GROUP BY 1)
 SELECT CAST(r.r AS INT) AS sector, r.r * 22.5::DOUBLE AS center_deg, round(coalesce(n / (SELECT count(*) FROM w), 0), 6) AS frequency, round(coalesce(p90, 0), 6) AS pct_90, round(coalesce(p95, 0), 6) AS pct_95, round(coalesce(p99, 0), 6) AS pct_99 FROM unnest(range(16)) r(r) LEFT JOIN g ON g.sector = r.r""")
def _(i):
    """The rose of all days as one document, read back a row a sector."""
    path = shared_path(i.spark, "rose")
    days = i.weather_daily.select((F.col("wind_kmh") / 1.60934).alias("wind_speed_mph"), (F.col("day_no") * 37 % 360).cast("double").alias("wind_dir_deg"))
    K.write_wind_rose(wind_rose(days), path)
    read = i.spark.read.schema(", ".join(f"{n} array<double>" for n in ("sectors", "frequency", "pct_90", "pct_95", "pct_99"))).json(path)
    rows = read.select(F.posexplode(F.arrays_zip(*read.columns)).alias("sector", "s"))
    return rows.select("sector", F.col("s.sectors").alias("center_deg"), *(f"s.{n}" for n in read.columns[1:]))


@query("snk9_export_stats", f"{_W}, f AS (SELECT coalesce(round(round(max(toa), 9), 1), 0) AS arrival, count(toa) AS burned FROM runs) SELECT count(*) AS \"buildingCount\", round(round(avg(s), 9), 1) AS \"meanRisk\", round(round(max(s), 9), 1) AS \"maxRisk\", round(round(min(s), 9), 1) AS \"minRisk\", count(*) FILTER (s >= 55) AS \"highRiskCount\", count(*) FILTER (s >= 30 AND s < 55) AS \"moderateRiskCount\", count(*) FILTER (s < 30) AS \"lowRiskCount\", any_value(f.arrival) AS \"fireMaxArrival\", any_value(f.burned) AS \"fireBurnedCells\" FROM scored, f")
def _(i):
    """The summary of all buildings and all runs as one document, read back."""
    path = shared_path(i.spark, "stats")
    K.export_stats(scored(i), i.runs, path)
    counts, scores = ("buildingCount", "highRiskCount", "moderateRiskCount", "lowRiskCount", "fireBurnedCells"), ("meanRisk", "maxRisk", "minRisk", "fireMaxArrival")
    return i.spark.read.schema(", ".join([f"{n} long" for n in counts] + [f"{n} double" for n in scores])).json(path)


@query("src13_train_val_split", "SELECT CASE WHEN CAST('0x' || substr(md5(parcel_id), 1, 8) AS BIGINT) % 100 < 85 THEN 'train' ELSE 'validation' END AS split, count(*) AS count FROM properties GROUP BY 1")
def _(i):
    return R.train_val_split(i.properties, "parcel_id").groupBy("split").count()


@query("src14_constant_layers", "SELECT p.product, count(*) AS n, sum(v) AS total FROM cells CROSS JOIN (VALUES ('CC', 40.0), ('CH', 150.0)) p(product, v) GROUP BY 1")
def _(i):
    layers = R.constant_layers(i.spark, 50, 50, {"CC": 40.0, "CH": 150.0}).join(i.cells.select("row", "col"), ["row", "col"])
    return layers.groupBy("product").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


@query("src16_fallback_chain", "SELECT parcel_id, CASE WHEN CAST(parcel_id AS INT) % 2 = 0 THEN 'cache' WHEN CAST(parcel_id AS INT) % 3 = 0 THEN 'local' ELSE 'default' END AS origin FROM properties")
def _(i):
    ids = i.properties.select("parcel_id")
    k = F.col("parcel_id").cast("int")
    return R.first_available([("cache", ids.where(k % 2 == 0)), ("missing", None), ("local", ids.where(k % 3 == 0)), ("default", ids)], "parcel_id").select("parcel_id", "origin")


_SHAPE = "SELECT *, half <> 3 AS has, year_built > 0 AS known FROM scored"


@query("snk6_export_features", f"{_W}, x AS ({_SHAPE}) SELECT parcel_id AS id, name, round(round(s, 9), 1) AS score, {_CATEGORY} AS category, round(round({TERRAIN}, 9), 1) AS terrain, round(slope_degrees, 1) AS slope, CASE WHEN known THEN CAST(year_built AS INT) END AS year, CAST(stories AS INT) AS stories, round(ember_exposure_probability, 3) AS ember, 28 AS fields, 'Polygon' AS kind, 5 AS corners, round(-81 + (cx - half) / 100000, 6) AS west FROM x WHERE has")
def _(i):
    """Footprints as features with all their fields, read back; here a metre is 1/100,000 of a degree."""
    df = scored(i)
    ring = F.when(F.col("half") != 3, geo.square(F.col("cx"), F.col("cy"), F.col("half")))
    lonlat = F.transform(ring, lambda p: F.struct((p["x"] / 100000 - 81).alias("x"), (p["y"] / 100000 + 36).alias("y")))
    text = K.feature(lonlat, K.building_properties(df, components(), risk_category(F.col("wildfire_risk_score"))))
    path = shared_path(i.spark, "features")
    df.select(text.alias("value")).where("value is not null").write.text(path)
    out = i.spark.read.text(path)
    at = lambda name, kind: F.get_json_object("value", f"$.properties.{name}").cast(kind)
    pts = F.from_json(F.get_json_object("value", "$.geometry.coordinates"), "array<array<array<double>>>")[0]
    fields = F.size(F.json_object_keys(F.get_json_object("value", "$.properties"))) + F.lit(0)
    return out.select(at("id", "string").alias("id"), at("name", "string").alias("name"), at("riskScore", "double").alias("score"), at("riskCategory", "string").alias("category"), at("terrain", "double").alias("terrain"), at("slope", "double").alias("slope"), at("yearBuilt", "int").alias("year"), at("stories", "int").alias("stories"), at("emberProbability", "double").alias("ember"), fields.cast("int").alias("fields"), F.get_json_object("value", "$.geometry.type").alias("kind"), F.size(pts).alias("corners"), pts[0][0].alias("west"))


@query("snk4_write_param_layers", "SELECT c.row, c.col, round(CAST(coalesce(m.w1, 0) AS FLOAT)::DOUBLE, 5) AS w1, round(CAST(coalesce(m.mx, 0) AS FLOAT)::DOUBLE, 5) AS mx FROM fuel_cells c LEFT JOIN fuel_models m ON m.code = c.fbfm40", 5)
def _(i):
    from perilframe.operators.vegetation import PARAMETERS, map_fuel_models

    path = shared_path(i.spark, "layers")
    K.write_param_layers(map_fuel_models(i.fuel_cells, i.fuel_models), path, list(PARAMETERS))
    return i.spark.read.parquet(path).select("row", "col", F.col("w1").cast("double").alias("w1"), F.col("mx").cast("double").alias("mx"))


@query("snk8_export_isochrones", f"{_LINES}, f AS (SELECT run_id, level, line, closed, count(*) AS vertices, round(sum(x), 4) AS sum_x, round(sum(y), 4) AS sum_y FROM lines GROUP BY 1, 2, 3, 4) SELECT round(level, 6) AS minutes, CASE WHEN level < 1 THEN CAST(CAST(level * 60 AS INT) AS VARCHAR) || ' sec' ELSE CAST(CAST(level AS INT) AS VARCHAR) || ' min' END AS label, 'LineString' AS kind, vertices, sum_x, sum_y FROM f")
def _(i):
    """Whole lines of every run as features, read back: a row for each."""
    path = shared_path(i.spark, "isochrones")
    K.export_isochrones(isochrones(i), path)
    value = i.spark.read.text(path)
    at = lambda name: F.get_json_object("value", f"$.{name}")
    points = F.from_json(at("geometry.coordinates"), "array<array<double>>")
    total = lambda k: F.round(F.aggregate("points", F.lit(0.0), lambda s, p: s + p[k]), 4)
    read = value.select(at("properties.minutes").cast("double").alias("minutes"), at("properties.label").alias("label"), at("geometry.type").alias("kind"), points.alias("points"))
    return read.select("minutes", "label", "kind", F.size("points").cast("long").alias("vertices"), total(0).alias("sum_x"), total(1).alias("sum_y"))


@query("snk5_write_twins", "SELECT parcel_id, county, CAST(stories AS INT) AS stories, round(slope_degrees, 6) AS slope FROM properties")
def _(i):
    path = shared_path(i.spark, "twins")
    K.write_twin_documents(i.properties, path)
    doc = lambda name, kind: F.get_json_object("value", f"$.{name}").cast(kind)
    return i.spark.read.text(path).select(doc("parcel_id", "string").alias("parcel_id"), doc("county", "string").alias("county"), doc("stories", "int").alias("stories"), doc("slope_degrees", "double").alias("slope"))


@query("snk7_arrival_sample", "SELECT run_id, row, col FROM runs WHERE row % 4 = 0 AND col % 4 = 0 AND toa IS NOT NULL AND intensity > 0")
def _(i):
    return K.arrival_sample(i.runs, 4).select("run_id", "row", "col")


@query("snk11_step_status")
def _(i):
    return K.step_status(i.spark, {"points": lambda: i.points, "cells": lambda: i.cells, "broken": lambda: i.cells.select("no_such_column")}).drop("seconds", "error")
