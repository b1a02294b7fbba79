"""Parcels, footprints and what is inferred of buildings; distances between them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from perilframe import dims
from perilframe.functions import geometry as geo
from perilframe.operators.iterate import stored
from perilframe.operators.nearest import nearest_other

#: Standard column: source names in order of preference.
COLUMNS = {
    "parcel_id": ["parcelid", "pid", "parid", "objectid"],
    "owner_name": ["ownername", "owner", "owner1"],
    "address": ["siteaddress", "address", "site_address", "fulladdress"],
    "land_use": ["landuse", "land_use_code", "proptype", "lu_code"],
    "year_built": ["yearbuilt", "year_built", "yr_built"],
    "assessed_value": ["totalvalue", "total_value", "assessed_value"],
    "building_sf": ["totalsqft", "bldgsf", "grosssqft"],
    "stories": ["stories", "numstories"],
}


def standardize_parcels(df: DataFrame) -> DataFrame:
    """The first source column found for each standard one is renamed to it, in any case."""
    have = {c.lower(): c for c in df.columns}
    renames = {}
    for standard, candidates in COLUMNS.items():
        found = next((have[c] for c in candidates if c in have), None)
        if found and found != standard and standard not in df.columns:
            renames[found] = standard
    return df.withColumnsRenamed(renames)


def flag_owner(df: DataFrame, keywords: list[str]) -> DataFrame:
    """df with is_owner_flagged: the owner's name has one of the keywords."""
    if "owner_name" not in df.columns:
        return df.withColumn("is_owner_flagged", F.lit(False))
    pattern = "|".join(f"\\Q{k.upper()}\\E" for k in keywords)
    return df.withColumn("is_owner_flagged", F.coalesce(F.upper("owner_name").rlike(pattern), F.lit(False)))


def assemble_footprints(ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """ways (id, nodes) as rings through the nodes (id, x, y) in order; fewer than four corners, or no area: none."""
    at = ways.select("id", F.posexplode("nodes").alias("pos", "node_id"))
    met = at.join(nodes.select(F.col("id").alias("node_id"), "x", "y"), "node_id")
    rings = met.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "x", "y"))).alias("p"))
    ring = F.transform("p", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))
    return ways.drop("nodes").join(rings.where(F.size("p") >= 4).select("id", ring.alias("ring")), "id").where(geo.area(F.col("ring")) > 0)


def footprint_attributes(df: DataFrame, keyword: str) -> DataFrame:
    """Footprints (id, tags) with parcel_id, name, stories (2 if unknown), flag and year 0."""
    tag = lambda k: F.col("tags")[k]
    has = lambda k: F.coalesce(F.contains(F.lower(tag(k)), F.lit(keyword.lower())), F.lit(False))
    stories = F.coalesce(F.floor(F.expr("try_cast(tags['building:levels'] as double)")).cast("int"), F.lit(2))
    return df.withColumns({"parcel_id": F.concat(F.lit("OSM_"), F.col("id").cast("string")), "name": F.coalesce(tag("name"), F.lit("")), "stories": stories, "is_owner_flagged": has("operator") | has("name"), "year_built": F.lit(0)})


def footprint_area(df: DataFrame, least_m2: float = 20.0) -> DataFrame:
    """Rows of more than the least area; it is exploded from an array of one, so that the filter works with the value and doesn't work it out again."""
    measured = df.select("*", F.explode(F.array(geo.polygon_area(geo.rings_of(df)))).alias("area_m2"))
    return measured.where(F.col("area_m2") > least_m2).withColumn("building_sf", F.col("area_m2") * 10.764)


def clip_bbox(df: DataFrame, x0: float, y0: float, x1: float, y1: float) -> DataFrame:
    """Rows whose polygon's box meets the box."""
    b = geo.polygon_box(geo.rings_of(df))
    return df.where((b["x0"] <= x1) & (b["x1"] >= x0) & (b["y0"] <= y1) & (b["y1"] >= y0))


def within_boundary(df: DataFrame, boundary: Column, several: bool = False) -> DataFrame:
    """Rows (cx, cy) inside a polygon, given as an array of its corners, or of its rings."""
    rings = boundary if several else F.array(boundary)
    return df.where(geo.polygon_contains(rings, F.col("cx"), F.col("cy")))


def twin_identity(df: DataFrame) -> DataFrame:
    pick = lambda c, d: F.coalesce(F.nullif(c, F.lit(0).cast(dict(df.dtypes)[c])), F.lit(d))
    return df.select("parcel_id", F.coalesce("name", F.lit("")).alias("name"), pick("year_built", 1975).alias("year_built"), pick("stories", 1).alias("stories"), pick("building_sf", 0.0).alias("building_sf"), pick("assessed_value", 0.0).alias("assessed_value"))


def stable_hash(key: Column) -> Column:
    """0 to 99, the same in every run and engine."""
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint") % 100


def infer_year(df: DataFrame, kind: str = "land_use") -> DataFrame:
    """Year built of rows without one (0 or 1975), by type and size, spread by a hash of the id."""
    h, t = stable_hash(F.col("parcel_id")), F.col(kind)
    guess = (
        F.when(t.isin("church", "chapel"), F.lit(1932))
        .when(t.isin("dormitory", "residential"), 1925 + h % 50)
        .when(t.isin("university", "academic"), 1930 + h % 60)
        .when((F.col("stories") >= 3) | (F.col("building_sf") > 15000), 1950 + h % 40)
        .when(F.col("building_sf") < 2000, 1960 + h % 40)
        .otherwise(1940 + h % 50)
    )
    return df.withColumn("year_built", F.when(F.col("year_built").isin(0, 1975), guess).otherwise(F.col("year_built")).cast("int"))


def infer_roof(df: DataFrame, kind: str = "land_use") -> DataFrame:
    """Roof material and confidence, by type, height, size and age."""
    t, n, sf = F.col(kind), F.col("stories"), F.col("building_sf")
    roof = lambda m, c: F.struct(F.lit(m).alias("roof_material"), F.lit(c).alias("roof_material_confidence"))
    r = (
        F.when(t.isin("church", "chapel"), roof("slate_tile", 0.6))
        .when((n >= 4) | (sf > 20000), roof("membrane_flat", 0.7))
        .when((n >= 3) | (sf > 8000), roof("built_up_tar", 0.5))
        .when(t.isin("garage", "shed", "service"), roof("metal", 0.6))
        .when(F.col("year_built") < 1940, roof("slate_tile", 0.4))
        .otherwise(roof("asphalt_shingles", 0.5))
    )
    return df.withColumn("_r", r).withColumn("roof_material", F.col("_r.roof_material")).withColumn("roof_material_confidence", F.col("_r.roof_material_confidence")).drop("_r")


def infer_vents(year: Column) -> Column:
    return F.when(year >= 2000, "screened").when(year >= 1970, "partial").otherwise("unscreened")


def canopy_from_ndvi(ndvi: Column) -> Column:
    return F.greatest(F.lit(0.0), (ndvi - 0.1) / 0.5 * 100)


# --- proximity: candidates by bucket, then exact distances ----------------------------------


def zone_of(distance: Column) -> Column:
    """The ring outside a building that a distance is in: (0, 1.5], (1.5, 9], (9, 30.5] metres."""
    return F.when(distance <= 0, F.lit(None).cast("int")).when(distance <= 1.5, 1).when(distance <= 9, 2).when(distance <= 30.5, 3)


def zone_cells(buildings: DataFrame, cells: DataFrame, reach: float = 30.5, share: int = 256) -> DataFrame:
    """(parcel_id, zone, cell columns): the cells (x, y) around each building (parcel_id, ring or rings). A hole is outside.

    Buildings are dealt to the buckets that their box, widened by the reach, meets; cells are in one
    bucket each. A bucket of more than ``share`` buildings is dealt in shares of about as many, each with
    the bucket's cells, so that no task has a whole downtown.
    """
    size = 2 * reach
    rings = geo.rings_of(buildings)
    b = buildings.select("parcel_id", geo.all_sides(rings).alias("_sides"), geo.polygon_box(rings).alias("b"))
    span = lambda lo, hi: F.sequence(F.floor((F.col(f"b.{lo}") - reach) / size), F.floor((F.col(f"b.{hi}") + reach) / size))
    b = b.withColumn("_bx", F.explode(span("x0", "x1"))).withColumn("_by", F.explode(span("y0", "y1")))
    c = cells.withColumn("_bx", F.floor(F.col("x") / size)).withColumn("_by", F.floor(F.col("y") / size))
    hot = b.groupBy("_bx", "_by").agg(F.ceil(F.count(F.lit(1)) / share).cast("int").alias("_shares")).where("_shares > 1")
    shares = F.coalesce("_shares", F.lit(1))
    b = b.join(hot, ["_bx", "_by"], "left").withColumn("_share", F.pmod(F.xxhash64("parcel_id", "b"), shares).cast("int")).drop("_shares")
    c = c.join(hot, ["_bx", "_by"], "left").withColumn("_share", F.explode(F.sequence(F.lit(0), shares - 1))).drop("_shares")
    met = b.join(c, ["_bx", "_by", "_share"]).where(F.col("x").between(F.col("b.x0") - reach, F.col("b.x1") + reach) & F.col("y").between(F.col("b.y0") - reach, F.col("b.y1") + reach))
    distance = F.when(geo.odd_crossings(F.col("_sides"), F.col("x"), F.col("y")), 0.0).otherwise(geo.nearest_side(F.col("_sides"), F.col("x"), F.col("y")))
    once = F.get(F.transform(F.array(distance), zone_of), F.lit(0))
    return met.withColumn("zone", once).where("zone is not null").drop("_bx", "_by", "_share", "b", "_sides")


def once_a_shape(buildings: DataFrame, measure: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """measure(shapes), a table with parcel_id, for each of the buildings (parcel_id, ring or rings): equal polygons are measured once, by the name of a digest of their corners."""
    keyed = buildings.withColumn("_shape", F.coalesce(F.md5(F.to_json(geo.rings_of(buildings))), F.lit("none")))
    outlines = [c for c in ("ring", "rings") if c in buildings.columns]
    shapes = keyed.groupBy(F.col("_shape").alias("parcel_id")).agg(*(F.first(c).alias(c) for c in outlines))
    found = measure(shapes).withColumnRenamed("parcel_id", "_shape")
    return keyed.select("parcel_id", "_shape").join(found, "_shape").drop("_shape")


def zone_metrics(buildings: DataFrame, zoned: DataFrame, threshold: float = 0.0) -> DataFrame:
    """Loads, canopy, dominant fuel, ladder fuel and continuity; zoned has load, model, canopy_height.

    Buildings without a ring have nulls, no ladder fuel and the fuel 'unknown'; rings without cells 0.
    """
    in_zone = lambda z, c: F.when(F.col("zone") == z, c)
    ladder = F.max(in_zone(2, F.col("model").isin(dims.LADDER_ZONE).cast("int"))) == 1
    agg = zoned.groupBy("parcel_id").agg(
        *(F.avg(in_zone(z, F.col("load"))).alias(f"zone{z}_fuel_load") for z in (1, 2, 3)), F.avg(in_zone(2, F.col("canopy_height"))).alias("zone2_canopy"),
        F.mode(in_zone(2, F.col("model")), True).alias("zone2_dominant_fuel"), ladder.alias("_l"), F.avg(in_zone(3, (F.col("load") > threshold).cast("double"))).alias("zone3_fuel_continuity"),
    )
    out = buildings.select("parcel_id", F.col("ring").isNotNull().alias("_has")).join(agg, "parcel_id", "left")
    zero = lambda c: F.when(F.col("_has"), F.coalesce(c, F.lit(0.0))).alias(c)
    return out.select(
        "parcel_id", *(zero(f"zone{z}_fuel_load") for z in (1, 2, 3)), zero("zone2_canopy"), F.when(F.col("_has"), F.coalesce("zone2_dominant_fuel", F.lit("NB9"))).otherwise("unknown").alias("zone2_dominant_fuel"),
        F.coalesce(F.col("_l") & (F.col("zone2_canopy") > 2), F.lit(False)).alias("ladder_fuel_present"), zero("zone3_fuel_continuity"),
    )


def neighbor_distance(footprints: DataFrame) -> DataFrame:
    """(parcel_id, neighbor_distance_m): from each footprint (ring or rings) to the nearest other one, null without any.

    Equal polygons are taken once, by a digest of their corners, so that a site with many copies costs one row; copies
    are 0 apart. Inside is what an odd number of rings hold. Footprints without a ring have none.
    """
    rings = geo.rings_of(footprints)
    f = footprints.select("parcel_id", rings.alias("rings"), F.md5(F.to_json(rings)).alias("k"))
    whole = f.where("rings is not null").groupBy("k").agg(F.first("rings").alias("rings"), F.count(F.lit(1)).alias("n"))
    sites = stored(whole.withColumn("id", F.monotonically_increasing_id()), "sites")
    found = sites.select("k", "n", "id").join(nearest_other(sites.select("id", "rings")), "id", "left")
    out = f.select("parcel_id", "k").join(found, "k", "left")
    return out.select("parcel_id", F.when(F.col("n") > 1, 0.0).otherwise(F.col("d")).alias("neighbor_distance_m"))


def neighbor_flag(distance: Column) -> Column:
    return F.coalesce(distance < 15, F.lit(False))


def proximity_report(buildings: DataFrame, cells: DataFrame, threshold: float = 0.0) -> DataFrame:
    """Every measure of the rings around each building, its distance to the nearest other one, and the flag of less than 15 m. cells are those of ``zone_cells``, with what ``zone_metrics`` takes."""
    near = neighbor_distance(buildings)
    return once_a_shape(buildings, lambda b: zone_metrics(b, zone_cells(b, cells), threshold)).join(near, "parcel_id").withColumn("neighbor_flag_15m", neighbor_flag(F.col("neighbor_distance_m")))


def build_twins(properties: DataFrame, layers: dict[str, DataFrame], defaults: dict[str, object]) -> DataFrame:
    """properties with every layer's columns, left-joined on parcel_id, and defaults for what is missing."""
    out = properties
    for layer in layers.values():
        fresh = [c for c in layer.columns if c == "parcel_id" or c not in out.columns]
        out = out.join(layer.select(*fresh), "parcel_id", "left")
    return out.fillna({k: v for k, v in defaults.items() if k in out.columns})


