"""Tables of fixed values. All are small by definition and are broadcast where they are joined."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# --- fixed values ---------------------------------------------------------------------

#: code, model, loads 1 h, 10 h, 100 h, live herb, live wood (tons an acre), depth (ft), moisture of extinction, sigma, heat
FUEL_MODELS = [
    (101, "GR1", 0.10, 0.0, 0.0, 0.30, 0.0, 0.4, 0.15, 2200.0, 8000.0),
    (102, "GR2", 0.10, 0.0, 0.0, 1.0, 0.0, 1.0, 0.15, 2000.0, 8000.0),
    (103, "GR3", 0.10, 0.40, 0.0, 1.50, 0.0, 2.0, 0.30, 1500.0, 8000.0),
    (104, "GR4", 0.25, 0.0, 0.0, 1.90, 0.0, 2.0, 0.15, 2000.0, 8000.0),
    (107, "GR7", 1.00, 0.0, 0.0, 5.40, 0.0, 3.0, 0.15, 2000.0, 8000.0),
    (121, "TL1", 1.0, 2.20, 3.60, 0.0, 0.0, 0.2, 0.30, 2000.0, 8000.0),
    (123, "TL3", 0.50, 2.20, 2.80, 0.0, 0.0, 0.3, 0.25, 2000.0, 8000.0),
    (128, "TL8", 0.30, 1.40, 8.10, 0.0, 0.0, 0.2, 0.35, 1750.0, 8000.0),
    (129, "TL9", 0.30, 3.50, 9.00, 0.0, 0.0, 0.6, 0.35, 1750.0, 8000.0),
    (141, "TU1", 0.20, 0.90, 1.50, 0.20, 0.90, 1.0, 0.20, 1750.0, 8000.0),
    (145, "TU5", 1.0, 1.0, 3.0, 0.30, 2.0, 1.0, 0.25, 1500.0, 8000.0),
    (161, "SH1", 0.25, 0.25, 0.0, 0.15, 1.30, 1.0, 0.15, 1750.0, 8000.0),
    (165, "SH5", 0.45, 2.45, 0.0, 0.0, 7.00, 6.0, 0.15, 750.0, 8000.0),
    (169, "SH9", 1.65, 3.30, 0.0, 1.10, 4.50, 4.4, 0.40, 750.0, 8000.0),
    (91, "NB1", 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.99, 0.0, 0.0),
    (99, "NB9", 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.99, 0.0, 0.0),
]
FUEL_SCHEMA = "code int, model string, w1 double, w10 double, w100 double, lh double, lw double, delta double, mx double, sigma double, h double"
#: Models that count as ladder fuel, by cell and in the ring around a building.
LADDER_CELLS = ["TU1", "TU5", "SH1", "SH5", "SH9", "GR2", "GR3", "GR4"]
LADDER_ZONE = ["TU1", "TU5", "SH1", "SH5", "SH9", "GR3", "GR4"]

TPI_CLASS = {"valley": 0, "mid_slope": 1, "upper_slope": 2, "ridge": 3}
ROOF_CLASS = {
    "metal_standing_seam": 0, "metal_corrugated": 0, "concrete_clay_tile": 1, "asphalt_shingles": 2,
    "built_up_tar_gravel": 2, "membrane_flat": 2, "wood_shingles_shake": 3, "unknown_occluded": 2,
}
ROOF_POINTS = {0: 0.0, 1: 5.0, 2: 12.0, 3: 20.0}

#: feature, default, weight, category, controllable, label
FEATURES = [
    ("slope_degrees", 0.0, 0.5, "terrain", False, "Terrain slope"),
    ("heat_load_index", 0.0, 5.0, "terrain", False, "Heat load index"),
    ("tpi_class_encoded", 1.0, 1.0, "terrain", False, "Topographic position"),
    ("upslope_profile_100m", 0.0, 1.0, "terrain", False, "100m upslope gradient"),
    ("upslope_profile_300m", 0.0, 1.0, "terrain", False, "300m upslope gradient"),
    ("upslope_profile_500m", 0.0, 1.0, "terrain", False, "500m upslope gradient"),
    ("zone1_fuel_load", 0.0, 20.0, "vegetation", True, "Zone 1 fuel load (0-5ft)"),
    ("zone2_fuel_load", 0.0, 5.0, "vegetation", True, "Zone 2 fuel load (5-30ft)"),
    ("zone3_fuel_load", 0.0, 2.0, "vegetation", True, "Zone 3 fuel load (30-100ft)"),
    ("zone3_fuel_continuity", 0.5, 1.0, "vegetation", True, "Zone 3 fuel continuity"),
    ("ndvi_mean", 0.0, 1.0, "vegetation", False, "Mean NDVI"),
    ("dry_veg_fraction_mean", 0.0, 1.0, "vegetation", False, "Dry vegetation fraction"),
    ("canopy_cover_pct", 0.0, 1.0, "vegetation", True, "Canopy cover"),
    ("ladder_fuel_present", 0.0, 8.0, "vegetation", True, "Ladder fuels present"),
    ("roof_material_encoded", 2.0, 6.0, "structure", True, "Roof material"),
    ("vent_screened", 0.0, -12.0, "structure", True, "Vent screening"),
    ("year_built", 1975.0, 1.0, "structure", False, "Year built"),
    ("neighbor_distance_m", 100.0, -0.1, "exposure", False, "Neighbor distance"),
    ("ember_exposure_probability", 0.0, 5.0, "exposure", False, "Ember exposure probability"),
]

#: action, set roof, set vent, set zone 1, zone 2 factor, zone 3 continuity cap, clears ladder, set deck, cost low, high, category
ACTIONS = [
    ("replace_wood_roof_with_metal", "metal_standing_seam", None, None, 1.0, None, False, None, 15000, 45000, "structure"),
    ("screen_all_vents", None, "screened", None, 1.0, None, False, None, 500, 2000, "structure"),
    ("clear_zone1_combustibles", None, None, 0.0, 1.0, None, False, None, 200, 800, "vegetation"),
    ("replace_zone1_mulch_with_gravel", None, None, 0.02, 1.0, None, False, None, 300, 1200, "vegetation"),
    ("remove_ladder_fuels", None, None, None, 0.6, None, True, None, 1500, 5000, "vegetation"),
    ("reduce_zone2_fuels", None, None, None, 0.5, 0.4, False, None, 2000, 6000, "vegetation"),
    ("replace_wood_deck", None, None, None, 1.0, None, False, "composite_fire_resistant", 8000, 25000, "structure"),
    ("install_ember_resistant_fence", None, None, None, 0.8, None, False, None, 3000, 12000, "vegetation"),
]
ACTION_SCHEMA = "action string, set_roof string, set_vent string, set_z1 double, z2_mult double, cap_z3c double, clears_ladder boolean, set_deck string, cost_low int, cost_high int, category string"

#: tree, node, feature, threshold, left, right, value: a small ensemble of regression trees, for trials. Leaves have no feature.
TREES = [
    (0, 0, "slope_degrees", 18.5, 1, 2, None), (0, 1, "roof_material_encoded", 1.5, 3, 4, None), (0, 2, "zone1_fuel_load", 0.75, 5, 6, None),
    (0, 3, None, None, None, None, 0.21), (0, 4, None, None, None, None, 0.34), (0, 5, None, None, None, None, 0.43), (0, 6, None, None, None, None, 0.58),
    (1, 0, "vent_screened", 0.5, 1, 2, None), (1, 1, None, None, None, None, 0.125), (1, 2, "ember_exposure_probability", 0.4, 3, 4, None),
    (1, 3, None, None, None, None, -0.08), (1, 4, None, None, None, None, 0.03),
    (2, 0, None, None, None, None, 0.05),
]
TREE_SCHEMA = "tree int, node int, feature string, threshold double, left int, right int, value double"

#: use type, score knots and loss shares
LOSS_KNOTS = (0.0, 25.0, 50.0, 75.0, 100.0)
LOSS_CURVES = {
    "residential": (0.0001, 0.001, 0.005, 0.02, 0.08),
    "educational": (0.0001, 0.0008, 0.004, 0.015, 0.06),
    "medical": (0.0001, 0.0005, 0.003, 0.012, 0.05),
}
#: return period, coefficient, exponent of the peak flow regression
FLOOD_REGRESSION = [(2, 174.0, 0.68), (5, 303.0, 0.70), (10, 415.0, 0.71), (25, 586.0, 0.73), (50, 727.0, 0.74), (100, 890.0, 0.75), (500, 1330.0, 0.77)]
#: fuel code, ignition receptivity
RECEPTIVITY = [(101, 0.8), (102, 1.0), (104, 1.2), (107, 1.3), (121, 0.6), (123, 0.7), (128, 0.8), (129, 0.9), (141, 0.7), (161, 1.0), (91, 0.0), (99, 0.0)]
#: scenario, wind mph, wind bearing, 1 h fuel moisture
SCENARIOS = [("worst", 35.0, 225.0, 0.04), ("moderate", 20.0, 225.0, 0.07), ("low", 10.0, 225.0, 0.12)]
#: terrain class, wind multiplier
WIND_MULTIPLIER = [("ridge", 1.4), ("upper_slope", 1.2), ("mid_slope", 1.0), ("valley", 0.6)]
#: the maximal arrival up to which the levels hold, and the levels
ISOCHRONES = [(5.0, (0.5, 1.0, 2.0, 3.0, 4.0, 5.0)), (30.0, (1.0, 2.0, 5.0, 10.0, 15.0, 20.0, 30.0)), (120.0, (5.0, 10.0, 20.0, 30.0, 60.0, 90.0, 120.0)), (1e18, (10.0, 30.0, 60.0, 120.0, 180.0, 240.0, 360.0))]
#: product, least and greatest valid value
PRODUCT_RANGES = [("FBFM40", 1.0, 299.0), ("CC", 0.0, 100.0), ("CH", 0.0, 3700.0), ("CBD", 0.0, 60.0), ("CBH", 0.0, 3700.0), ("EVT", 1.0, 9999.0)]
#: month, normal daily high and low (F), precipitation (in)
CLIMATE = list(zip(range(1, 13), (50, 54, 63, 72, 79, 87, 90, 88, 82, 71, 62, 52), (30, 32, 40, 49, 58, 67, 71, 70, 63, 51, 41, 32), (3.6, 3.3, 4.1, 3.0, 3.5, 3.8, 4.5, 4.2, 3.9, 3.4, 3.0, 3.1)))
#: land cover, Manning's roughness
ROUGHNESS = [("water", 0.03), ("developed", 0.05), ("barren", 0.04), ("forest", 0.12), ("shrub", 0.08), ("grass", 0.05), ("crop", 0.06), ("wetland", 0.1)]

# --- tables ----------------------------------------------------------------------------


def loss_segments() -> list[tuple]:
    return [(use, lo, hi, a, b) for use, ys in LOSS_CURVES.items() for lo, hi, a, b in zip(LOSS_KNOTS, LOSS_KNOTS[1:], ys, ys[1:])]


#: Classes of labelled roof patches, in the order of their numbers.
ROOF_CLASSES = ["metal_standing_seam", "metal_corrugated", "concrete_clay_tile", "asphalt_shingles", "wood_shingles_shake", "built_up_tar_gravel", "membrane_flat", "unknown_occluded"]

TABLES: dict[str, tuple[list[tuple], str]] = {
    "roof_classes": (list(enumerate(ROOF_CLASSES)), "class_id int, label string"),
    "fuel_models": (FUEL_MODELS, FUEL_SCHEMA),
    "actions": (ACTIONS, ACTION_SCHEMA),
    "trees": (TREES, TREE_SCHEMA),
    "features": (FEATURES, "feature string, dflt double, weight double, category string, controllable boolean, label string"),
    "loss_segments": (loss_segments(), "use_type string, lo double, hi double, y0 double, y1 double"),
    "flood_regression": (FLOOD_REGRESSION, "period int, a double, b double"),
    "receptivity": (RECEPTIVITY, "code int, receptivity double"),
    "scenarios": (SCENARIOS, "scenario string, wind_mph double, wind_dir double, m1 double"),
    "wind_multiplier": (WIND_MULTIPLIER, "tpi_class string, multiplier double"),
    "isochrones": ([(lo, hi, x) for lo, (hi, xs) in zip((-1.0, 5.0, 30.0, 120.0), ISOCHRONES) for x in xs], "above double, upto double, level double"),
    "product_ranges": (PRODUCT_RANGES, "product string, lo double, hi double"),
    "climate": ([(int(m), float(a), float(b), float(c)) for m, a, b, c in CLIMATE], "month int, tmax_f double, tmin_f double, precip_in double"),
    "roughness": (ROUGHNESS, "cover string, n double"),
    "wind_bins": ([(float(d), float(s), i * 3 + j) for i, d in enumerate(range(0, 360, 45)) for j, s in enumerate((10, 20, 30))], "bin_dir double, bin_speed double, ord int"),
}


def dim(spark: SparkSession, name: str) -> DataFrame:
    rows, schema = TABLES[name]
    return spark.createDataFrame(rows, schema)


def as_sql() -> dict[str, str]:
    """The same tables as SELECTs over VALUES."""
    out = {}
    kind = {"int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    for name, (rows, schema) in TABLES.items():
        columns = [c.strip().split(" ") for c in schema.split(",")]
        value = lambda x: "NULL" if x is None else ("'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x).lower() if isinstance(x, bool) else repr(x))
        values = ", ".join("(" + ", ".join(map(value, r)) + ")" for r in rows)
        select = ", ".join(f"CAST(c{i} AS {kind[t]}) AS {c}" for i, (c, t) in enumerate(columns))
        out[name] = f"SELECT {select} FROM (VALUES {values}) AS t({', '.join(f'c{i}' for i in range(len(columns)))})"
    return out
