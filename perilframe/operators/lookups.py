"""Answers to requests over the property table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from perilframe.operators.attribution import best_controllable, controllable_columns, largest
from perilframe.operators.iterate import stored
from perilframe.operators.mitigation import mitigation_total, with_metrics
from perilframe.operators.scoring import components, risk_category


#: Characters of a gram.
GRAM = 3


def _grams(text: str, n: int) -> Column:
    """The distinct runs of n characters of a text; none of a shorter one."""
    each = F.transform(F.sequence(F.lit(1), F.length(text) - (n - 1)), lambda i: F.substring(F.col(text), i, F.lit(n)))
    return F.array_distinct(F.when(F.length(text) >= n, each).otherwise(F.array().cast("array<string>")))


def first_containing(texts: DataFrame, hay: DataFrame) -> DataFrame:
    """(text, id) of distinct texts: the least id of hay (id, hay) whose hay contains the text; texts in none are left out.

    Grams that some text has are counted over hay. A text is compared with those alone that hold its rarest gram, so a
    gram that all of them hold brings nothing together. A text shorter than a gram is a gram of its own length, of which
    the least id is enough. Equal hays are taken once.
    """
    held = stored(hay.where("hay is not null").groupBy("hay").agg(F.min("id").alias("id")), "hay")
    texts = stored(texts.select("text", F.least(F.length("text"), F.lit(GRAM)).alias("n")).distinct(), "texts")
    found = [texts.where(F.lit(False)).select("text", F.lit(None).cast(hay.schema["id"].dataType).alias("id"))]
    for n in sorted(r["n"] for r in texts.where("n > 0").select("n").distinct().collect()):
        mine, each = texts.where(F.col("n") == n), held.select("id", "hay", F.explode(_grams("hay", n)).alias("gram"))
        parts = mine.select("text", F.explode(_grams("text", n)).alias("gram"))
        if n < GRAM:
            found.append(each.select("id", F.col("gram").alias("text")).join(mine.select("text"), "text", "left_semi").groupBy("text").agg(F.min("id").alias("id")))
            continue
        known = each.join(parts.select("gram").distinct(), "gram", "left_semi").groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
        rarest = parts.join(known, "gram", "left").groupBy("text").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("r")).select("text", F.col("r.gram").alias("gram"))
        met = each.join(rarest, "gram").where(F.col("hay").contains(F.col("text")))
        found.append(met.groupBy("text").agg(F.min("id").alias("id")))
    return reduce(DataFrame.unionByName, found)


def resolve_property(requests: DataFrame, properties: DataFrame) -> DataFrame:
    """(request_id, parcel_id) by id, else the least id whose address and name contain the request's text, in any case.

    requests has request_id, parcel_id and text; empty and missing texts find nothing.
    """
    known = properties.select(F.col("parcel_id").alias("found"))
    by_id = requests.join(known, F.col("parcel_id") == F.col("found"), "left")
    hit = by_id.where("found is not null").select("request_id", F.col("found").alias("resolved_id"))
    open_ = by_id.where("found is null").select("request_id", F.lower("text").alias("text"))
    hay = properties.select(F.col("parcel_id").alias("id"), F.lower(F.concat_ws(" ", "address", "name")).alias("hay"))
    match = first_containing(open_.where("text is not null and text <> ''"), hay).withColumnRenamed("id", "resolved_id")
    return hit.unionByName(open_.join(match, "text", "left").select("request_id", "resolved_id"))


def assess(requests: DataFrame, scored: DataFrame) -> DataFrame:
    """A nested record for each request of a known property; scored has attributions."""
    some = lambda rows, name: F.when(F.size(rows) > 0, F.transform(rows, lambda x: F.struct(x["rank"].alias("rank"), x["feature"].alias("feature"), x["contribution"].alias("contribution")))).alias(name)
    record = scored.select(
        "parcel_id", F.coalesce(F.nullif("address", F.lit("")), F.col("name")).alias("address"), "wildfire_risk_score", risk_category(F.col("wildfire_risk_score")).alias("risk_category"),
        F.struct("slope_degrees", "tpi_class", "heat_load_index").alias("terrain"), F.struct("zone1_fuel_load", "zone2_fuel_load", "zone3_fuel_load", "ladder_fuel_present").alias("vegetation"),
        F.struct("roof_material", "vent_screening_status", "year_built").alias("structure"), F.when(F.col("ember_exposure_probability") > 0, F.col("ember_exposure_probability")).alias("ember_exposure_probability"),
        some(largest(5), "top_risk_drivers"), some(best_controllable(3), "top_mitigations"),
    )
    return requests.select("request_id", "parcel_id").join(record, "parcel_id")


def explain(scored: DataFrame, base_value: float = 50.0) -> DataFrame:
    """Each property's score with all its attributions in order, totals, the largest driver, and a summary; scored has attributions."""
    first = F.col("attributions")[0]
    every = scored.select("parcel_id", "wildfire_risk_score", largest(1 << 30).alias("attributions"))
    out = every.select("*", *controllable_columns())
    tenth = lambda c: F.format_string("%.1f", F.round(F.round(c, 9), 1))
    summary = F.concat(F.lit("Risk score "), tenth(F.col("wildfire_risk_score")), F.lit("/100. Controllable: "), tenth(F.col("controllable_points")), F.lit(" pts. Top action: "), F.coalesce(first["label"], F.lit("N/A")), F.lit("."))
    return out.withColumns({"base_value": F.lit(base_value), "main_driver": first["label"], "main_contribution": first["contribution"], "summary": summary})


def mitigate(requests: DataFrame, sequence: DataFrame) -> DataFrame:
    """A row for each request and action: scores before and after the step, what it gains and costs, its rank by gain, and the totals."""
    order = Window.partitionBy("parcel_id").orderBy(F.desc(F.round("points", 9)), "step")
    steps = with_metrics(sequence).withColumn("priority_rank", F.row_number().over(order))
    steps = steps.withColumn("cost_per_risk_point", F.concat("cost_per_point_low", F.lit("–"), "cost_per_point_high")).drop("original")
    return requests.select("request_id", "parcel_id").join(steps, "parcel_id").join(mitigation_total(sequence), "parcel_id")


def overview(scored: DataFrame, score: str = "wildfire_risk_score", top: int = 10) -> DataFrame:
    """One row over all properties: counts, mean of positive scores of flagged owners, and their highest ones."""
    mine = F.col("is_owner_flagged")
    s = F.col(score)
    totals = scored.agg(
        F.count(F.lit(1)).alias("total_properties"), F.count_if(mine).alias("flagged_properties"), F.coalesce(F.avg(F.when(mine & (s > 0), s)), F.lit(0.0)).alias("mean_wildfire_risk"),
        F.count_if(mine & (s > 55)).alias("high_risk_count"), F.count_if(mine & (s > 75)).alias("very_high_risk_count"),
    )
    best = scored.where(mine).orderBy(F.desc(F.round(s, 9)), "parcel_id").limit(top).select("parcel_id", score)
    names = best.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.round(s, 9)).alias("s"), "parcel_id"))), lambda x: x["parcel_id"]), ",").alias("highest_risk_properties"))
    return totals.crossJoin(names)  # one row each


def stats_row(scored: DataFrame, score: str = "wildfire_risk_score") -> DataFrame:
    """Count, mean, extremes and class counts of scores."""
    s = F.col(score)
    return scored.agg(F.count(F.lit(1)).alias("buildings"), F.avg(s).alias("mean_risk"), F.max(s).alias("max_risk"), F.min(s).alias("min_risk"), F.count_if(s >= 55).alias("high"), F.count_if((s >= 30) & (s < 55)).alias("moderate"), F.count_if(s < 30).alias("low"))


def validate_requests(requests: DataFrame) -> DataFrame:
    """requests with valid and the first reason against it. Columns that a request lacks take their defaults."""
    given = lambda name, default: F.col(name) if name in requests.columns else F.lit(default)
    rules = [
        ("missing parcel_id", F.col("parcel_id").isNull()), ("latitude", ~F.col("ignition_lat").between(35.5, 36.5)), ("longitude", ~F.col("ignition_lon").between(-79.5, -78.5)), ("wind speed", ~F.col("wind_speed_mph").between(0, 60)),
        ("wind direction", ~given("wind_direction_degrees", 225.0).between(0, 360)), ("fire weather index", ~given("fire_weather_index", 20.0).between(0, 100)), ("minutes", ~given("max_time_minutes", 60).between(5, 240)),
        ("runs", ~given("n_simulations", 1).between(1, 100)), ("assessment runs", ~given("n_assessments", 100).between(10, 1000)),
    ]
    reason = F.coalesce(*(F.when(F.coalesce(bad, F.lit(True)), F.lit(name)) for name, bad in rules))
    return requests.withColumn("reason", reason).withColumn("valid", reason.isNull())


def display_name() -> Column:
    return F.coalesce(F.nullif("name", F.lit("")), F.nullif("address", F.lit("")), F.col("parcel_id"))


def titled(text: Column) -> Column:
    return F.initcap(F.replace(text, F.lit("_"), F.lit(" ")))


def narrative(scored: DataFrame) -> DataFrame:
    """A few sentences about each property; canopy_cover_pct and fire_arrival_min (null: never reached) may be missing."""
    for c in ("canopy_cover_pct", "fire_arrival_min"):
        if c not in scored.columns:
            scored = scored.withColumn(c, F.lit(None).cast("double"))
    c = components()
    labels = {"structure": (35, "structural vulnerabilities"), "vegetation": (30, "surrounding vegetation"), "terrain": (25, "terrain characteristics"), "exposure": (10, "exposure to neighboring structures")}
    # Ties go to the earlier label.
    ranked = [F.struct(F.round(c[k] / most, 9).alias("share"), F.lit(-i).alias("order"), F.lit(label).alias("label")) for i, (k, (most, label)) in enumerate(labels.items())]
    driver = F.greatest(*ranked)["label"]
    s, name, roof, slope = F.col("wildfire_risk_score"), display_name(), F.col("roof_material"), F.col("slope_degrees")
    say = lambda *x: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in x))
    opening = (
        F.when(s < 30, say(name, " has relatively low wildfire risk."))
        .when(s < 55, say(name, " faces moderate wildfire risk, primarily driven by ", driver, "."))
        .when(s < 75, say(name, " has elevated wildfire risk. The main concern is ", driver, "."))
        .otherwise(say(name, " is at serious wildfire risk, with ", driver, " as the primary driver."))
    )
    roofing = (
        F.when(roof.rlike("wood|shake"), "Its wood roof is highly combustible and vulnerable to ember ignition.")
        .when(roof.contains("asphalt"), "Asphalt shingles provide moderate fire resistance but can ignite under sustained ember exposure.")
        .when(roof.contains("metal"), "Its metal roof offers strong fire resistance.")
        .when(roof.rlike("slate|tile"), "Its slate/tile roof is highly fire-resistant, though embers can enter through gaps.")
        .when(roof.rlike("membrane|flat"), "Its flat membrane roof has good fire resistance but is susceptible to pooling debris ignition.")
        .when(roof.rlike("built|tar"), "Its built-up roof provides moderate fire resistance.")
    )
    vents = F.when(F.col("vent_screening_status") == "unscreened", "Unscreened vents could allow embers to enter the attic.").when(F.col("vent_screening_status") == "partial", "Partially screened vents reduce but don't eliminate ember intrusion risk.")
    steep = F.when(slope > 10, say("A steep ", F.floor(slope + 0.5).cast("string"), "° slope accelerates fire spread toward the structure.")).when(slope > 5, say("Moderate slope (", F.floor(slope + 0.5).cast("string"), "°) contributes to fire spread."))
    ridge = F.when(F.col("tpi_class").isin("ridge", "upper_slope"), "Its elevated position on a ridge increases flame and ember exposure.")
    ladder = F.when(F.col("ladder_fuel_present") > 0, "Ladder fuels nearby could carry ground fire into the canopy.")
    whole = lambda x: F.floor(x + 0.5).cast("string")
    cover = F.when(F.col("canopy_cover_pct") > 40, say("Dense canopy cover (", whole(F.col("canopy_cover_pct")), "%) creates continuous fuel overhead."))
    minutes = F.col("fire_arrival_min")
    arrival = F.when(minutes < 5, say("In worst-case conditions, fire would reach this building in under ", F.ceil(minutes).cast("string"), " minutes.")).when(minutes.isNotNull(), say("Simulated fire arrival is ", whole(minutes), " minutes under worst-case conditions."))
    ember = F.when(F.col("ember_exposure_probability") > 0.7, "Ember exposure probability is high — firebrands from upwind fuel sources pose a significant ignition risk.")
    return scored.select("parcel_id", F.concat_ws(" ", opening, roofing, vents, steep, ridge, ladder, cover, arrival, ember).alias("narrative"))


#: What a row of the map says of a property, beside its name and box.
MAP_FIELDS = [
    "name", "address", "composite_risk_score", "slope_degrees", "aspect_degrees", "heat_load_index", "tpi_class", "twi", "zone1_fuel_load", "zone2_fuel_load", "zone3_fuel_load", "ladder_fuel_present", "ndvi_mean", "canopy_cover_pct",
    "roof_material", "roof_material_confidence", "year_built", "structure_type", "vent_screening_status", "building_sf", "neighbor_distance_m", "neighbor_flag_15m", "ember_exposure_probability", "fire_arrival_time_p50", "fire_arrival_time_p90", "is_owner_flagged",
]


def map_rows(scored: DataFrame) -> DataFrame:
    """A flat row for each property with its box and centre; fields that the table lacks are null, but the flag of near neighbours is derived."""
    for c in MAP_FIELDS:
        if c not in scored.columns:
            scored = scored.withColumn(c, F.coalesce(F.col("neighbor_distance_m") < 15, F.lit(False)) if c == "neighbor_flag_15m" else F.lit(None).cast("double"))
    return scored.select(
        *MAP_FIELDS,
        "parcel_id", display_name().alias("title"), risk_category(F.col("wildfire_risk_score")).alias("category"), "wildfire_risk_score", titled(F.col("roof_material")).alias("roof"),
        F.when(F.col("year_built") > 0, F.col("year_built").cast("int")).alias("year"), (F.col("cx") - F.col("half")).alias("x0"), (F.col("cy") - F.col("half")).alias("y0"), (F.col("cx") + F.col("half")).alias("x1"), (F.col("cy") + F.col("half")).alias("y1"),
    )


def map_bounds(rows: DataFrame) -> DataFrame:
    return rows.agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")).withColumns({"x": (F.col("x0") + F.col("x1")) / 2, "y": (F.col("y0") + F.col("y1")) / 2})


