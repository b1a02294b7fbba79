"""Queries of grids, terrain, vegetation and weather, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from perilframe.operators import grid as G
from perilframe.operators import terrain as T
from perilframe.operators import vegetation as V
from perilframe.operators import weather as W
from perilframe.plans.registry import query

RES = 20.0
_EXT = f"SELECT min(x) AS xmin, max(x) AS xmax, min(y) AS ymin, max(y) AS ymax, CAST(ceil((max(x) - min(x)) / {RES}) AS INT) AS n_cols, CAST(ceil((max(y) - min(y)) / {RES}) AS INT) AS n_rows FROM points"
_PLACED = f"SELECT p.*, CAST(least(greatest(floor((ymax - y) / {RES}), 0), n_rows - 1) AS INT) AS row, CAST(least(greatest(floor((x - xmin) / {RES}), 0), n_cols - 1) AS INT) AS col FROM points p, ext"
_P = f"WITH ext AS ({_EXT}), placed AS ({_PLACED})"


@query("grid1_grid_extent", f"SELECT * FROM ({_EXT})")
def _(i):
    return G.grid_extent(i.points, RES)


@query("grid2_assign_cell", f"{_P} SELECT row, col, count(*) AS n, round(sum(x), 3) AS sx FROM placed GROUP BY 1, 2")
def _(i):
    return G.assign_cell(i.points, G.grid_extent(i.points, RES), RES).groupBy("row", "col").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("x"), 3).alias("sx"))


_LAYERS = {
    "grid4_rasterize_max": ("dsm", "max(z)"),
    "grid7_building_mask": ("building", "CAST(max(CASE WHEN classification = 6 THEN 1 ELSE 0 END) AS INT)"),
    "grid8_mean_intensity": ("intensity", "avg(intensity)"),
    "grid6_surface_model": ("dsm", "max(z)"),
}
for _name, (_column, _sql) in _LAYERS.items():
    query(_name, f"{_P} SELECT row, col, {'round(' + _sql + ', 9)' if 'CAST' not in _sql else _sql} AS {_column} FROM placed GROUP BY 1, 2", 9)(lambda i, c=_column: G.rasterize(i.points, RES).select("row", "col", c))


@query("grid5_ground_dem", f"{_P}, g AS (SELECT count(*) FILTER (classification = 2) AS n FROM points) SELECT row, col, round(avg(CASE WHEN g.n > 100 AND classification <> 2 THEN NULL ELSE z END), 9) AS dem FROM placed, g GROUP BY 1, 2", 9)
def _(i):
    return G.rasterize(i.points, RES).select("row", "col", "dem")


# Means are in feet: in metres many end in a 5 at the last place, which two engines may round apart.
@query("grid3_rasterize_mean", f"{_P} SELECT row, col, round(avg(z) / 0.3048, 6) AS z FROM placed GROUP BY 1, 2")
def _(i):
    return G.rasterize(i.points, RES).select("row", "col", (F.col("z") / 0.3048).alias("z"))


@query("grid6_surface_mean", f"{_P} SELECT row, col, round(avg(z) / 0.3048, 6) AS dsm FROM placed GROUP BY 1, 2")
def _(i):
    return G.rasterize(i.points, RES, surface="mean").select("row", "col", (F.col("dsm") / 0.3048).alias("dsm"))


@query("grid3_full_grid", f"{_P}, m AS (SELECT row, col, avg(z) AS z FROM placed GROUP BY 1, 2) SELECT CAST(r.r AS INT) AS row, CAST(c.c AS INT) AS col, round(m.z / 0.3048, 6) AS z FROM ext, unnest(range(n_rows)) r(r), unnest(range(n_cols)) c(c) LEFT JOIN m ON m.row = r.r AND m.col = c.c")
def _(i):
    return G.rasterize(i.points, RES, fill=True).select("row", "col", (F.col("z") / 0.3048).alias("z"))


@query("grid9_canopy_height", "SELECT row, col, round(greatest(dsm - dem, 0), 9) AS chm FROM cells", 9)
def _(i):
    return i.cells.select("row", "col", G.canopy_height(F.col("dsm"), F.col("dem")).alias("chm"))


_HOLES = "WITH h AS (SELECT row, col, CASE WHEN (row * 7 + col * 3) % 11 = 0 THEN NULL ELSE z END AS z FROM cells)"


@query("grid10_fill_nearest", _HOLES + """, v AS (SELECT * FROM h WHERE z IS NOT NULL), d AS (SELECT h.row, h.col, h.z, v.z AS vz, row_number() OVER (PARTITION BY h.row, h.col ORDER BY (h.row - v.row) * (h.row - v.row) + (h.col - v.col) * (h.col - v.col), v.row, v.col) AS k FROM h, v)
 SELECT row, col, round(coalesce(z, vz), 9) AS z FROM d WHERE k = 1""", 9)
def _(i):
    holes = i.cells.select("row", "col", F.when((F.col("row") * 7 + F.col("col") * 3) % 11 == 0, F.lit(None)).otherwise(F.col("z")).alias("z"))
    return G.fill_nearest(holes)


@query("grid11_class_filter", "SELECT tile, count(*) AS n, round(avg(z), 6) AS z FROM points WHERE classification = 2 GROUP BY 1")
def _(i):
    return G.class_filter(i.points, 2).groupBy("tile").agg(F.count(F.lit(1)).alias("n"), F.avg("z").alias("z"))


_CRS_X = "CASE tile WHEN 'A' THEN x + 2000000 WHEN 'N' THEN x + 700000 ELSE x END"


@query("grid12_detect_crs", f"SELECT tile, CASE WHEN avg({_CRS_X}) BETWEEN 1500000 AND 2200000 THEN 2264 WHEN avg({_CRS_X}) BETWEEN 600000 AND 750000 THEN 32617 ELSE 2264 END AS crs FROM points GROUP BY 1")
def _(i):
    moved = i.points.withColumn("x", F.expr(_CRS_X))
    return G.detect_crs(moved).select("tile", "crs")


@query("grid13_utm_round_trip", "SELECT parcel_id, round(-79 + cx / 5000, 6) AS lon, round(36 + cy / 5000, 6) AS lat FROM properties")
def _(i):
    from perilframe.functions.geometry import from_utm, to_utm

    x, y = to_utm(-79 + F.col("cx") / 5000, 36 + F.col("cy") / 5000)
    step = i.properties.select("parcel_id", x.alias("x"), y.alias("y"))
    lon, lat = from_utm(F.col("x"), F.col("y"))
    return step.select("parcel_id", F.round(lon, 6).alias("lon"), F.round(lat, 6).alias("lat"))


@query("grid14_regrid_nearest", "SELECT CAST(r.r AS INT) AS row, CAST(c.c AS INT) AS col, round(z, 9) AS z FROM unnest(range(25)) r(r), unnest(range(25)) c(c) LEFT JOIN cells ON row = floor((r.r + 0.5) * 2) AND col = floor((c.c + 0.5) * 2)", 9)
def _(i):
    return G.regrid_nearest(i.cells, "z", 25, 25, 2.0)


@query("grid14_regrid_bilinear", """WITH t AS (SELECT r.r, c.c, (r.r + 0.5) * 0.37 - 0.5 AS y, (c.c + 0.5) * 0.37 - 0.5 AS x FROM unnest(range(135)) r(r), unnest(range(135)) c(c)),
 k AS (SELECT *, floor(y) + a.a AS rr, floor(x) + b.b AS cc FROM t, unnest([0, 1]) a(a), unnest([0, 1]) b(b)), w AS (SELECT k.*, z, (1 - abs(y - rr)) * (1 - abs(x - cc)) AS w FROM k LEFT JOIN cells ON cells.row = rr AND cells.col = cc)
 SELECT CAST(r AS INT) AS row, CAST(c AS INT) AS col, round(sum(z * w) / nullif(sum(CASE WHEN z IS NOT NULL THEN w END), 0), 6) AS z FROM w GROUP BY 1, 2""")
def _(i):
    return G.regrid_bilinear(i.cells, "z", 135, 135, 0.37)


@query("grid15_cell_xy", f"SELECT row, col, (col + 0.5) * {RES} AS x, 1001.0 - (row + 0.5) * {RES} AS y FROM cells")
def _(i):
    x, y = G.cell_xy(0.0, 1001.0, RES)
    return i.cells.select("row", "col", x.alias("x"), y.alias("y"))


_AT = f"CAST(least(greatest(floor((1001.0 - cy) / {RES}), 0), 49) AS INT)", f"CAST(least(greatest(floor(cx / {RES}), 0), 49) AS INT)"


@query("grid16_sample_nearest", f"SELECT parcel_id, round(coalesce(z, -1), 9) AS z FROM properties p LEFT JOIN cells c ON c.row = {_AT[0]} AND c.col = {_AT[1]}", 9)
def _(i):
    return G.sample_nearest(i.properties.select("parcel_id", "cx", "cy"), i.cells, {"z": -1.0}, 0.0, 1001.0, RES, 50, 50).select("parcel_id", "z")


_AT2 = f"CAST(least(greatest(floor((1001.0 - cy) / {RES}), 0), 29) AS INT)", f"CAST(least(greatest(floor(cx / {RES}), 0), 29) AS INT)"


@query("grid17_sample_or_mean", f"SELECT parcel_id, round(CASE WHEN cx BETWEEN 0 AND 600 AND cy BETWEEN 401 AND 1001 THEN z ELSE (SELECT avg(z) FROM cells) END, 9) AS z FROM properties p LEFT JOIN cells c ON c.row = {_AT2[0]} AND c.col = {_AT2[1]}", 9)
def _(i):
    return G.sample_or_mean(i.properties.select("parcel_id", "cx", "cy"), i.cells, "z", 0.0, 1001.0, RES, 30, 30).select("parcel_id", "z")


@query("grid18_locate_cell", f"WITH ext AS ({_EXT}) SELECT CAST(least(greatest(floor((ymax - 333.3) / {RES}), 0), n_rows - 1) AS INT) AS row, CAST(least(greatest(floor((444.4 - xmin) / {RES}), 0), n_cols - 1) AS INT) AS col FROM ext")
def _(i):
    return G.locate_cell(i.spark, 444.4, 333.3, G.grid_extent(i.points, RES), RES)


_BANDS = {"fbfm40": "FBFM40", "canopy_height": "CH", "canopy_base": "CBH", "slope_deg": "CC", "aspect_deg": "OTHER"}
_LAYERS_SQL = " UNION ALL ".join(f"SELECT row, col, '{p}' AS product, CAST({b} AS DOUBLE) AS value FROM fuel_cells" for b, p in _BANDS.items())


@query("src7_split_band_stack", f"SELECT product, count(*) AS n, round(sum(value), 6) AS total FROM ({_LAYERS_SQL}) GROUP BY 1")
def _(i):
    return G.split_bands(i.fuel_cells, _BANDS).groupBy("product").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


@query("grid19_validate_range", f"WITH s AS (SELECT product, min(value) AS least, max(value) AS most, count(value) AS n FROM ({_LAYERS_SQL}) GROUP BY 1) SELECT s.product, least, most, n, CASE WHEN n = 0 THEN false WHEN lo IS NULL THEN true ELSE least >= lo AND most <= hi END AS ok FROM s LEFT JOIN product_ranges r ON r.product = s.product")
def _(i):
    return G.validate_range(G.split_bands(i.fuel_cells, _BANDS), i.product_ranges)


# --- terrain ------------------------------------------------------------------------------

_GRAD = f"""WITH g AS (SELECT row, col, z, CASE WHEN lag(z) OVER a IS NULL AND lead(z) OVER a IS NULL THEN 0 WHEN lag(z) OVER a IS NULL THEN lead(z) OVER a - z WHEN lead(z) OVER a IS NULL THEN z - lag(z) OVER a ELSE (lead(z) OVER a - lag(z) OVER a) / 2 END / {RES} AS dx,
 -(CASE WHEN lag(z) OVER b IS NULL AND lead(z) OVER b IS NULL THEN 0 WHEN lag(z) OVER b IS NULL THEN lead(z) OVER b - z WHEN lead(z) OVER b IS NULL THEN z - lag(z) OVER b ELSE (lead(z) OVER b - lag(z) OVER b) / 2 END / {RES}) AS dy FROM cells WINDOW a AS (PARTITION BY row ORDER BY col), b AS (PARTITION BY col ORDER BY row)),
 s AS (SELECT row, col, z, degrees(atan(sqrt(dx * dx + dy * dy))) AS slope_deg, fmod(degrees(atan2(dx, dy)) + 360, 360) AS aspect_deg FROM g)"""


@query("ter1_slope_aspect", f"{_GRAD} SELECT row, col, round(slope_deg, 6) AS slope_deg, round(aspect_deg, 6) AS aspect_deg FROM s")
def _(i):
    return T.slope_aspect(i.cells, RES).select("row", "col", "slope_deg", "aspect_deg")


@query("ter2_northness_eastness", "SELECT row, col, round(cos(radians(aspect_deg)), 6) AS northness, round(sin(radians(aspect_deg)), 6) AS eastness FROM fuel_cells")
def _(i):
    return i.fuel_cells.select("row", "col", T.northness(F.col("aspect_deg")).alias("northness"), T.eastness(F.col("aspect_deg")).alias("eastness"))


def _box(k: int) -> str:
    def one(src, col, to, part, order):
        return f"""SELECT *, (sum({col}) OVER (PARTITION BY {part} ORDER BY {order} ROWS BETWEEN {k} PRECEDING AND {k} FOLLOWING) + greatest(0, {k} - (pos - 1)) * f + greatest(0, {k} - (n - pos)) * l) / {2 * k + 1}.0 AS {to} FROM
 (SELECT *, row_number() OVER (PARTITION BY {part} ORDER BY {order}) AS pos, count(*) OVER (PARTITION BY {part}) AS n, first_value({col}) OVER (PARTITION BY {part} ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS f, last_value({col}) OVER (PARTITION BY {part} ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS l FROM {src})"""

    return f"WITH b1 AS ({one('(SELECT row, col, z FROM cells)', 'z', 'm1', 'row', 'col')}), b2 AS ({one('(SELECT row, col, z, m1 FROM b1)', 'm1', 'm2', 'col', 'row')}), t AS (SELECT row, col, z - m2 AS tpi FROM b2)"


@query("ter3_tpi", _box(3) + " SELECT row, col, round(tpi, 6) AS tpi FROM t")
def _(i):
    return T.tpi(i.cells, RES, 60.0).select("row", "col", "tpi")


@query("ter4_tpi_class", _box(3) + ", d AS (SELECT stddev_pop(tpi) AS sd FROM t) SELECT row, col, CASE WHEN tpi > sd THEN 'ridge' WHEN tpi > 0.5 * sd THEN 'upper_slope' WHEN tpi > -0.5 * sd THEN 'mid_slope' ELSE 'valley' END AS tpi_class FROM t, d")
def _(i):
    return T.tpi_class(T.tpi(i.cells, RES, 60.0)).select("row", "col", "tpi_class")


_NB = """WITH a AS (SELECT row, col, z, coalesce(lag(z) OVER (PARTITION BY row ORDER BY col), z) AS w, coalesce(lead(z) OVER (PARTITION BY row ORDER BY col), z) AS e FROM cells),
 n AS (SELECT row, col, z, w, e, coalesce(lag(w) OVER b, w) AS nw, coalesce(lag(z) OVER b, z) AS n, coalesce(lag(e) OVER b, e) AS ne, coalesce(lead(w) OVER b, w) AS sw, coalesce(lead(z) OVER b, z) AS s, coalesce(lead(e) OVER b, e) AS se FROM a WINDOW b AS (PARTITION BY col ORDER BY row))"""


@query("ter5_tri", _NB + " SELECT row, col, round(sqrt((nw-z)*(nw-z) + (n-z)*(n-z) + (ne-z)*(ne-z) + (w-z)*(w-z) + (e-z)*(e-z) + (sw-z)*(sw-z) + (s-z)*(s-z) + (se-z)*(se-z)), 6) AS tri FROM n")
def _(i):
    return T.tri(i.cells).select("row", "col", "tri")


@query("ter6_heat_load", "SELECT row, col, round(least(greatest((1 - cos(radians(aspect_deg - 45))) / 2 * sin(radians(slope_deg)), 0), 1), 6) AS heat_load FROM fuel_cells")
def _(i):
    return i.fuel_cells.select("row", "col", T.heat_load(F.col("slope_deg"), F.col("aspect_deg")).alias("heat_load"))


@query("ter7_twi", "SELECT row, col, round(least(greatest(ln((1 + row * col) * 400.0 / tan(radians(greatest(slope_deg, 0.001)))), 0), 30), 6) AS twi FROM fuel_cells")
def _(i):
    return i.fuel_cells.select("row", "col", T.wetness(F.lit(1) + F.col("row") * F.col("col"), F.col("slope_deg"), RES).alias("twi"))


@query("ter8_upslope_profile", f"""WITH p AS (SELECT parcel_id AS id, {_AT[0]} AS row, {_AT[1]} AS col FROM properties), a AS (SELECT p.*, aspect_deg FROM p JOIN fuel_cells c ON c.row = p.row AND c.col = p.col),
 st AS (SELECT id, k.k, CAST(row - floor(k.k * cos(radians(aspect_deg)) + 0.5) AS INT) AS r, CAST(col + floor(k.k * sin(radians(aspect_deg)) + 0.5) AS INT) AS c FROM a, unnest(range(1, 26)) k(k)), m AS (SELECT id, k, slope_deg FROM st JOIN fuel_cells f ON f.row = r AND f.col = c)
 SELECT p.id, {", ".join(f"round(coalesce(avg(slope_deg) FILTER (k <= {b // 20}), 0), 6) AS upslope_profile_{b}m" for b in (100, 300, 500))} FROM p LEFT JOIN m ON m.id = p.id GROUP BY p.id""")
def _(i):
    places = i.properties.selectExpr("parcel_id AS id", f"{_AT[0]} AS row", f"{_AT[1]} AS col")
    return T.upslope_profile(places, i.fuel_cells, RES)


@query("ter9_terrain_features", f"{_GRAD} SELECT row, col, round(slope_deg, 6) AS slope_deg, round(cos(radians(aspect_deg)), 6) AS northness, round(least(greatest((1 - cos(radians(aspect_deg - 45))) / 2 * sin(radians(slope_deg)), 0), 1), 6) AS heat_load_index FROM s")
def _(i):
    return T.terrain_features(i.cells, RES).select("row", "col", "slope_deg", "northness", "heat_load_index")


# --- vegetation -----------------------------------------------------------------------------

_PX = "WITH p AS (SELECT row, col, red, red / 255.0::DOUBLE AS r, green / 255.0::DOUBLE AS g, blue / 255.0::DOUBLE AS b, nir / 255.0::DOUBLE AS nir FROM pixels), i AS (SELECT *, least(greatest((nir - r) / (nir + r + 1e-6), -1), 1) AS ndvi, least(greatest((g - nir) / (g + nir + 1e-6), -1), 1) AS ndwi, least(greatest(2.5 * (nir - r) / (nir + 6 * r - 7.5 * b + 1 + 1e-6), -1), 5) AS evi FROM p)"
for _name, _fn in (("ndvi", V.ndvi), ("ndwi", V.ndwi), ("evi", V.evi)):
    query(f"veg{('ndvi', 'ndwi', 'evi').index(_name) + 1}_{_name}", f"{_PX} SELECT row, col, round({_name}, 6) AS {_name} FROM i")(lambda i, n=_name, f=_fn: V.scaled_bands(i.pixels).select("row", "col", f().alias(n)))

_UN = ", ".join(f"least(greatest({' + '.join(f'({w}) * {c}' for w, c in zip(row, ('r', 'g', 'b', 'nir')))}, 0), 1) AS {n}0" for n, row in zip(("gv", "npv", "soil"), V.UNMIX))


@query("veg4_unmix", f"{_PX}, u AS (SELECT row, col, {_UN} FROM p) SELECT row, col, " + ", ".join(f"round({n}0 / (gv0 + npv0 + soil0 + 1e-6), 6) AS {n}" for n in ("gv", "npv", "soil")) + " FROM u")
def _(i):
    return V.unmix(V.scaled_bands(i.pixels)).select("row", "col", "gv", "npv", "soil")


@query("veg5_flammability_class", f"{_PX}, f AS (SELECT row, col, CASE WHEN ndvi < 0.05 THEN 0 WHEN ndvi <= 0.1 AND ndwi < -0.2 THEN 4 WHEN ndvi > 0.1 AND ndvi <= 0.3 AND ndwi < 0 THEN 3 WHEN ndvi > 0.3 AND ndvi <= 0.5 THEN 2 WHEN ndvi > 0.5 THEN 1 ELSE 0 END AS class FROM i) SELECT row, col, class FROM f")
def _(i):
    return V.scaled_bands(i.pixels).select("row", "col", V.flammability_class(V.ndvi(), V.ndwi()).alias("class"))


@query("veg6_zonal_veg_stats", f"""{_PX}, u AS (SELECT i.*, {_UN} FROM i), x AS (SELECT (col + 0.5) * 5 AS x, 1001.0 - (row + 0.5) * 5 AS y, ndvi, ndwi, evi, npv0 / (gv0 + npv0 + soil0 + 1e-6) AS npv FROM u WHERE red <> 0)
 SELECT parcel_id, round(avg(ndvi), 6) AS ndvi_mean, round(quantile_cont(ndvi, 0.9), 6) AS ndvi_p90, round(stddev_pop(ndvi), 6) AS ndvi_std, round(avg(ndwi), 6) AS ndwi_mean, round(avg(evi), 6) AS evi_mean, round(avg(npv), 6) AS dry_veg_fraction_mean, round(100 * avg(CASE WHEN ndvi > 0.4 THEN 1.0 WHEN ndvi IS NOT NULL THEN 0.0 END), 6) AS canopy_cover_pct
 FROM properties p LEFT JOIN x ON abs(x - cx) <= half AND abs(y - cy) <= half GROUP BY 1""")
def _(i):
    px = V.unmix(V.scaled_bands(i.pixels)).withColumns({"ndvi": V.ndvi(), "ndwi": V.ndwi(), "evi": V.evi()})
    return V.zonal_veg_stats(i.properties, px, 5.0, 0.0, 1001.0)


_FM = "WITH m AS (SELECT c.*, coalesce(f.model, 'NB9') AS model, coalesce(w1, 0) AS w1, coalesce(w10, 0) AS w10, coalesce(w100, 0) AS w100, coalesce(lh, 0) AS lh, coalesce(lw, 0) AS lw, coalesce(mx, 0) AS mx FROM fuel_cells c LEFT JOIN fuel_models f ON f.code = c.fbfm40)"


@query("veg7_map_fuel_models", f"{_FM} SELECT row, col, model, w1, w10, lw, mx FROM m")
def _(i):
    return V.map_fuel_models(i.fuel_cells, i.fuel_models).select("row", "col", "model", "w1", "w10", "lw", "mx")


@query("veg8_fuel_params", "WITH n AS (SELECT DISTINCT lower(CASE WHEN row % 3 = 0 THEN 'tl' || CAST(col % 10 AS VARCHAR) ELSE 'gr' || CAST(col % 10 AS VARCHAR) END) AS name FROM fuel_cells) SELECT name, coalesce(model, 'NB9') AS model, coalesce(w1, 0) AS w1, coalesce(mx, 0.99) AS mx FROM n LEFT JOIN fuel_models ON upper(name) = model")
def _(i):
    names = i.fuel_cells.select(F.concat(F.when(F.col("row") % 3 == 0, "tl").otherwise("gr"), (F.col("col") % 10).cast("string")).alias("name")).distinct()
    return V.fuel_params(names, i.fuel_models).select("name", "model", "w1", "mx")


@query("veg9_total_fuel_load", f"{_FM} SELECT row, col, round(w1 + w10 + w100 + lh + lw, 6) AS load FROM m")
def _(i):
    return V.map_fuel_models(i.fuel_cells, i.fuel_models).select("row", "col", V.total_fuel_load().alias("load"))


_LADDER = "model IN ('TU1','TU5','SH1','SH5','SH9','GR2','GR3','GR4') AND canopy_height > 2 AND canopy_base > 2"


@query("veg10_ladder_fuel_cells", f"{_FM} SELECT count(*) AS cells, count(*) FILTER ({_LADDER}) AS ladder FROM m")
def _(i):
    return V.map_fuel_models(i.fuel_cells, i.fuel_models).agg(F.count(F.lit(1)).alias("cells"), F.count_if(V.ladder_fuel()).alias("ladder"))


@query("veg11_fuel_summary", f"{_FM} SELECT count(DISTINCT model) AS models, count(*) FILTER (model NOT IN ('NB1', 'NB9')) AS burnable_cells, round(100.0 * count(*) FILTER (model NOT IN ('NB1', 'NB9')) / count(*), 6) AS burnable_pct FROM m")
def _(i):
    return V.fuel_summary(V.map_fuel_models(i.fuel_cells, i.fuel_models))


@query("veg12_dominant_burnable_code", f"{_FM}, d AS (SELECT min(model) AS model FROM m WHERE model NOT IN ('NB1', 'NB9')) SELECT coalesce(d.model, 'none') AS model, coalesce(f.code, 161) AS code FROM d LEFT JOIN fuel_models f ON f.model = d.model")
def _(i):
    return V.dominant_burnable_code(V.map_fuel_models(i.fuel_cells, i.fuel_models), i.fuel_models)


@query("veg13_fuel_coverage", "WITH n AS (SELECT CAST(floor(row / 10) AS INT) AS zone, fbfm40, count(*) AS n FROM fuel_cells GROUP BY 1, 2) SELECT zone, CAST(fbfm40 AS VARCHAR) AS code, round(n / sum(n) OVER (PARTITION BY zone), 6) AS share FROM n")
def _(i):
    out = V.fuel_coverage(V.map_fuel_models(i.fuel_cells, i.fuel_models), F.floor(F.col("row") / 10).cast("int"))
    return out.select("zone", F.explode("fuel_models").alias("code", "share"))


# --- weather ----------------------------------------------------------------------------------

_WX = "WITH f AS (SELECT station, date, " + ", ".join(f"arg_min(value, seq) FILTER (datatype = '{k}') AS {k}" for k in W.KINDS) + " FROM weather_long GROUP BY 1, 2), u AS (SELECT station, date, TMAX / 10 * 9 / 5 + 32 AS temp_f, TMIN / 10 * 9 / 5 + 32 AS temp_min_f, AWND / 10 * 2.23694 AS wind_speed_mph, WSF2 / 10 * 2.23694 AS wind_gust_mph, WDF2 AS wind_dir_deg, PRCP / 10 / 25.4 AS precip_in, least(greatest(100 * exp(17.625 * (TMIN / 10) / (243.04 + TMIN / 10)) / exp(17.625 * (TMAX / 10) / (243.04 + TMAX / 10)), 0), 100) AS rh_pct FROM f)"


def _daily(i):
    return W.unit_convert(W.pivot_daily(i.weather_long))


def _with_rh(i):
    wide = W.pivot_daily(i.weather_long)
    return W.unit_convert(wide).join(wide.select("station", "date", W.estimate_rh(F.col("TMAX") / 10, F.col("TMIN") / 10).alias("rh_pct")), ["station", "date"])


@query("wx1_pivot_daily", _WX + " SELECT station, CAST(date AS VARCHAR) AS day, " + ", ".join(W.KINDS) + " FROM f")
def _(i):
    return W.pivot_daily(i.weather_long).select("station", F.col("date").cast("string").alias("day"), *W.KINDS)


@query("wx2_unit_convert", _WX + " SELECT station, CAST(date AS VARCHAR) AS day, round(temp_f, 6) AS temp_f, round(temp_min_f, 6) AS temp_min_f, round(wind_speed_mph, 6) AS wind_speed_mph, round(precip_in, 6) AS precip_in FROM u")
def _(i):
    return _daily(i).select("station", F.col("date").cast("string").alias("day"), "temp_f", "temp_min_f", "wind_speed_mph", "precip_in")


@query("wx3_estimate_rh", _WX + " SELECT station, CAST(date AS VARCHAR) AS day, round(CASE WHEN temp_f IS NOT NULL AND temp_min_f IS NOT NULL THEN rh_pct END, 6) AS rh_pct FROM u")
def _(i):
    rh = W.estimate_rh(F.col("TMAX") / 10, F.col("TMIN") / 10)
    both = F.col("TMAX").isNotNull() & F.col("TMIN").isNotNull()
    return W.pivot_daily(i.weather_long).select("station", F.col("date").cast("string").alias("day"), F.when(both, rh).alias("rh_pct"))


@query("wx4_fire_weather_filter", "SELECT station, count(*) AS n FROM weather_daily WHERE rh_pct <= 60 AND temp_c * 9 / 5 + 32 >= 80 AND wind_kmh / 1.60934 >= 5 GROUP BY 1")
def _(i):
    df = i.weather_daily.withColumns({"temp_f": F.col("temp_c") * 9 / 5 + 32, "wind_speed_mph": F.col("wind_kmh") / 1.60934})
    return W.fire_weather_filter(df, 60.0, 5.0, 80.0).groupBy("station").agg(F.count(F.lit(1)).alias("n"))


_SECTOR = "CAST(floor(fmod(wind_dir_deg + 11.25, 360) / 22.5) AS INT)"


@query("wx5_wind_sector", _WX + f" SELECT {_SECTOR} AS sector, count(*) AS n FROM u WHERE wind_dir_deg IS NOT NULL GROUP BY 1")
def _(i):
    return _daily(i).where("wind_dir_deg is not null").groupBy(W.wind_sector(F.col("wind_dir_deg")).alias("sector")).agg(F.count(F.lit(1)).alias("n"))


_ROSE = "WITH w AS (SELECT wind_kmh / 1.60934 AS wind_speed_mph, CAST(day_no * 37 % 360 AS DOUBLE) AS wind_dir_deg FROM weather_daily)"


@query("wx6_wind_rose", f"""{_ROSE}, s AS (SELECT {_SECTOR} AS sector, * FROM w), g AS (SELECT sector, count(*) AS n, quantile_cont(wind_speed_mph, 0.9) AS p90, quantile_cont(wind_speed_mph, 0.95) AS p95, quantile_cont(wind_speed_mph, 0.99) AS p99 FROM s GROUP BY 1)
 SELECT CAST(r.r AS INT) AS sector, r.r * 22.5::DOUBLE AS center_deg, round(coalesce(n / (SELECT count(*) FROM w), 0), 6) AS frequency, round(coalesce(p90, 0), 6) AS p90, round(coalesce(p95, 0), 6) AS p95, round(coalesce(p99, 0), 6) AS p99 FROM unnest(range(16)) r(r) LEFT JOIN g ON g.sector = r.r""")
def _(i):
    return W.wind_rose(i.weather_daily.select((F.col("wind_kmh") / 1.60934).alias("wind_speed_mph"), (F.col("day_no") * 37 % 360).cast("double").alias("wind_dir_deg")))


@query("wx7_dominant_direction", _WX + " SELECT wind_dir_deg AS dominant_deg, count(*) AS n FROM u WHERE wind_dir_deg IS NOT NULL GROUP BY 1 ORDER BY n DESC, wind_dir_deg LIMIT 1")
def _(i):
    return W.dominant_direction(_daily(i))


@query("wx8_daily_to_metric", _WX + " SELECT station, CAST(date AS VARCHAR) AS day, round((temp_f - 32) * 5 / 9, 6) AS temp_c, round(coalesce(CASE WHEN temp_min_f IS NOT NULL THEN rh_pct END, 50), 6) AS rh_pct, round(coalesce(wind_speed_mph, 0) * 1.60934, 6) AS wind_kmh, round(coalesce(precip_in, 0) * 25.4, 6) AS precip_mm FROM u WHERE temp_f IS NOT NULL")
def _(i):
    df = _with_rh(i).withColumn("rh_pct", F.when(F.col("temp_f").isNotNull() & F.col("temp_min_f").isNotNull(), F.col("rh_pct")))
    return W.daily_to_metric(df).select("station", F.col("date").cast("string").alias("day"), "temp_c", "rh_pct", "wind_kmh", "precip_mm")


_FM_RATE = "(0.424 * (1 - pow({x}, 1.7)) + 0.0694 * sqrt(w) * (1 - pow({x}, 8))) * 0.581 * exp(0.0365 * t)"
_MO = "(147.2 * (101 - f) / (59.5 + f))"
_WX9 = f"""WITH RECURSIVE d AS (SELECT station, day_no, temp_c AS t, rh_pct AS h, wind_kmh AS w, precip_mm AS r FROM weather_daily),
 fold(station, day_no, ffmc, dmc, dc) AS (SELECT DISTINCT station, 0, 85.0::DOUBLE, 6.0::DOUBLE, 15.0::DOUBLE FROM d UNION ALL
 SELECT station, day_no, 59.5 * (250 - m) / (147.2 + m), CASE WHEN r > 1.5 THEN greatest(0, (CASE WHEN mr > 20 THEN 244.72 - 43.43 * ln(greatest(mr, 20.0000001) - 20) ELSE 0 END) + k) ELSE dm + k END,
  (CASE WHEN r > 2.8 THEN CASE WHEN qr > 0 THEN 400 * ln(800 / qr) ELSE 0 END ELSE c END) + 0.5 * greatest(-1.6, 0.36 * (t + 2.8) + 0.5) FROM (
 SELECT *, CASE WHEN mo > ed THEN ed + (mo - ed) * pow(10, -({_FM_RATE.format(x='(h / 100)')})) WHEN mo < ew THEN ew - (ew - mo) * pow(10, -({_FM_RATE.format(x='((100 - h) / 100)')})) ELSE mo END AS m, dmo + 1000 * re / (48.77 + bb * re) AS dmr, 20 + exp(5.6348 - dm / 43.43) + 1000 * re / (48.77 + bb * re) AS mr FROM (
 SELECT *, CASE WHEN r > 0.5 THEN least(250, m0 + 42.5 * (r - 0.5) * exp(-100 / (251 - m0)) * (1 - exp(-6.93 / (r - 0.5)))) ELSE m0 END AS mo, 20 + exp(5.6348 - dm / 43.43) AS dmo, CASE WHEN dm <= 65 THEN 65.91 + 11.2 * ln(20 + exp(5.6348 - dm / 43.43)) ELSE 200 / (0.999 + 0.23 * ln(dm)) END AS bb FROM (
 SELECT d.*, fold.ffmc AS f, fold.dmc AS dm, fold.dc AS c, 147.2 * (101 - fold.ffmc) / (59.5 + fold.ffmc) AS m0, 0.942 * pow(h, 0.679) + 11 * exp((h - 100) / 10) + 0.18 * (21.1 - t) * (1 - exp(-0.115 * h)) AS ed, 0.618 * pow(h, 0.753) + 10 * exp((h - 100) / 10) + 0.18 * (21.1 - t) * (1 - exp(-0.115 * h)) AS ew,
  greatest(0, 1.894 * (t + 1.1) * (100 - h) * greatest(9, 11.5 + 4.5 * sin(((d.day_no - 1) % 365 + 1 - 15) * 360 / 365.0 * pi() / 180)) * 1e-4) AS k, 0.92 * r - 1.27 AS re, 800 * exp(-fold.dc / 400) + 3.937 * (0.83 * r - 1.27) AS qr
  FROM fold JOIN d ON d.station = fold.station AND d.day_no = fold.day_no + 1)))),
 o AS (SELECT fold.*, d.w AS wk, 147.2 * (101 - ffmc) / (59.5 + ffmc) AS fm FROM fold JOIN d ON d.station = fold.station AND d.day_no = fold.day_no), o2 AS (SELECT *, 0.208 * exp(0.05039 * wk) * 91.9 * exp(-0.1386 * fm) * (1 + pow(fm, 5.31) / 4.93e7) AS isi, CASE WHEN dmc > 0 THEN 0.8 * dmc * dc / (dmc + 0.4 * dc) ELSE 0 END AS bui FROM o),
 o3 AS (SELECT *, 0.1 * isi * (CASE WHEN bui <= 80 THEN 0.626 * pow(bui, 0.809) + 2 ELSE 1000 / (25 + 108.64 * exp(-0.023 * bui)) END) AS b FROM o2)
 SELECT CAST(station AS INT) AS station, CAST(day_no AS INT) AS day_no, round(ffmc, 4) AS ffmc, round(dmc, 4) AS dmc, round(dc, 4) AS dc, round(isi, 4) AS isi, round(bui, 4) AS bui, round(CASE WHEN b > 1 THEN exp(2.72 * pow(0.434 * ln(greatest(b, 1)), 0.647)) ELSE b END, 4) AS fwi FROM o3"""


@query("wx9_fire_weather_index", _WX9)
def _(i):
    out = W.fire_weather_index(i.weather_daily)
    return out.select("station", "day_no", *(F.round(c, 4).alias(c) for c in ("ffmc", "dmc", "dc", "isi", "bui", "fwi")))


@query("wx10_fuel_moisture", "SELECT scenario, m1, round(m1 * 1.3, 6) AS m10, count(*) AS days FROM scenarios JOIN weather_daily ON wind_kmh / 1.60934 <= wind_mph GROUP BY 1, 2, 3")
def _(i):
    s = W.moisture_from_1hr(i.scenarios)
    return i.weather_daily.join(F.broadcast(s), F.col("wind_kmh") / 1.60934 <= F.col("wind_mph")).groupBy("scenario", "m1", "m10").agg(F.count(F.lit(1)).alias("days"))


_u = lambda stream: f"((CAST('0x' || substr(md5('42|' || station || '|' || strftime(date, '%Y-%m-%d') || '|{stream}'), 1, 12) AS BIGINT) + 0.5) / 281474976710656.0::DOUBLE)"
_n = lambda stream: f"sqrt(-2 * ln({_u(stream)})) * cos(2 * pi() * {_u(stream + chr(39) * 2)})"


@query("src15_climatology", f"""WITH sp AS (SELECT station, min(date) AS a, max(date) AS z FROM weather_daily GROUP BY 1), d AS (SELECT station, CAST(unnest(generate_series(a, z, INTERVAL 1 DAY)) AS DATE) AS date FROM sp),
 x AS (SELECT station, date, tmax_f + 5 * {_n('high')} AS temp_f, tmin_f + 5 * {_n('low')} AS temp_min_f, -4 * (ln(1 - {_u('wind 1')}) + ln(1 - {_u('wind 2')})) AS wind_speed_mph, 180.0 + 45 * floor({_u('direction')} * 3) AS wind_dir_deg, -ln(1 - {_u('rain')}) * precip_in / 30 AS precip_in FROM d JOIN climate c ON c.month = month(date))
 SELECT station, CAST(date AS VARCHAR) AS day, round(temp_f, 6) AS temp_f, round(temp_min_f, 6) AS temp_min_f, round(least(greatest(100 * exp(17.27 * ((temp_min_f - 32) * 5 / 9) / ((temp_min_f - 32) * 5 / 9 + 237.3)) / exp(17.27 * ((temp_f - 32) * 5 / 9) / ((temp_f - 32) * 5 / 9 + 237.3)), 20), 95), 6) AS rh_pct, round(wind_speed_mph, 6) AS wind_speed_mph, CAST(wind_dir_deg AS DOUBLE) AS wind_dir_deg, round(precip_in, 6) AS precip_in FROM x""")
def _(i):
    """Every station's series over the days of its records."""
    out = W.climatology(i.weather_daily.groupBy("station").agg(F.min("date").alias("start"), F.max("date").alias("end")), i.climate)
    return out.withColumn("date", F.col("date").cast("string")).withColumnRenamed("date", "day")
