"""Queries of scores, attributions, mitigations and requests, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from perilframe import dims
from perilframe.operators import attribution as A
from perilframe.operators import lookups as L
from perilframe.operators import mitigation as M
from perilframe.operators import scoring as S
from perilframe.plans.registry import Inputs, query


def _case(column: str, values: dict, default) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {float(v)}" for k, v in values.items()) + f" ELSE {float(default)} END"


#: The encoded view in SQL. Features that properties lack have their defaults.
ENCODED = f"""SELECT parcel_id, name, county, address, land_use, roof_material, vent_screening_status, tpi_class, is_owner_flagged, assessed_value, cx, cy, half, stories, building_sf,
 hand_m, distance_to_stream_m, cti, in_fema_100yr,
 slope_degrees, heat_load_index, {_case("tpi_class", dims.TPI_CLASS, 1)} AS tpi_class_encoded, 0.0::DOUBLE AS upslope_profile_100m, 0.0::DOUBLE AS upslope_profile_300m, 0.0::DOUBLE AS upslope_profile_500m,
 zone1_fuel_load, zone2_fuel_load, zone3_fuel_load, zone3_fuel_continuity, 0.0::DOUBLE AS ndvi_mean, 0.0::DOUBLE AS dry_veg_fraction_mean, 0.0::DOUBLE AS canopy_cover_pct,
 CAST(ladder_fuel_present AS DOUBLE) AS ladder_fuel_present, {_case("roof_material", dims.ROOF_CLASS, 2)} AS roof_material_encoded,
 CASE WHEN vent_screening_status = 'screened' THEN 1.0 ELSE 0.0 END AS vent_screened, CAST(year_built AS DOUBLE) AS year_built, neighbor_distance_m, ember_exposure_probability
 FROM properties"""
_ROOF_POINTS = "CASE CAST({r} AS INT) WHEN 0 THEN 0.0 WHEN 1 THEN 5.0 WHEN 2 THEN 12.0 WHEN 3 THEN 20.0 ELSE 10.0 END"
TERRAIN = "(least(slope_degrees * 0.5, 15) + heat_load_index * 5 + tpi_class_encoded * 2)"
VEGETATION = "(least({z1} * 20, 12) + least({z2} * 5, 10) + least(zone3_fuel_load * 2, 5) + {ladder} * 8)"
STRUCTURE = f"({_ROOF_POINTS.format(r='{roof}')} + (1 - {{vent}}) * 12)"
EXPOSURE = "(CASE WHEN neighbor_distance_m < 20 THEN greatest(0, 10 - neighbor_distance_m * 0.5) ELSE 0 END + ember_exposure_probability * 5)"


def score_sql(z1="zone1_fuel_load", z2="zone2_fuel_load", ladder="ladder_fuel_present", roof="roof_material_encoded", vent="vent_screened") -> str:
    return f"CAST(least(greatest({TERRAIN} + {VEGETATION.format(z1=z1, z2=z2, ladder=ladder)} + {STRUCTURE.format(roof=roof, vent=vent)} + {EXPOSURE}, 0), 100) AS DOUBLE)"


SCORED = f"SELECT *, {score_sql()} AS s FROM encoded"
_W = f"WITH encoded AS ({ENCODED}), scored AS ({SCORED})"
_CATEGORY = "CASE WHEN s < 30 THEN 'LOW' WHEN s < 55 THEN 'MODERATE' WHEN s < 75 THEN 'HIGH' ELSE 'VERY HIGH' END"
_FLOOD = "CAST(least(greatest(greatest(0, (10 - hand_m) * 5) + greatest(0, (1000 - distance_to_stream_m) * 0.05) + least(cti * 2, 20) + CASE WHEN in_fema_100yr THEN 30 ELSE 0 END, 0), 100) AS DOUBLE)"


def scored(i: Inputs):
    return S.wildfire_score(i.properties)


def encoded(i: Inputs):
    return S.encode_features(i.properties)


@query("sco1_encode_features", f"WITH encoded AS ({ENCODED}) SELECT parcel_id, " + ", ".join(f"round(CAST({n} AS DOUBLE), 6) AS {n}" for n in S.MODEL_FEATURES) + " FROM encoded")
def _(i):
    return encoded(i).select("parcel_id", *S.MODEL_FEATURES)


@query("sco1_feature_vector", f"WITH encoded AS ({ENCODED}) SELECT parcel_id, round(list_sum([" + ", ".join(S.MODEL_FEATURES) + "]), 6) AS vector_sum, 19 AS vector_length FROM encoded")
def _(i):
    v = encoded(i).select("parcel_id", S.feature_vector().alias("v"))
    return v.select("parcel_id", F.aggregate("v", F.lit(0.0), lambda a, x: a + x).alias("vector_sum"), F.size("v").alias("vector_length"))


@query("sco2_wildfire_score", f"{_W} SELECT parcel_id, round(s, 6) AS wildfire_risk_score FROM scored")
def _(i):
    return scored(i).select("parcel_id", "wildfire_risk_score")


@query("sco3_score_components", f"{_W} SELECT parcel_id, round(CAST({TERRAIN} AS DOUBLE), 6) AS terrain_points, round(CAST({VEGETATION.format(z1='zone1_fuel_load', z2='zone2_fuel_load', ladder='ladder_fuel_present')} AS DOUBLE), 6) AS vegetation_points, round(CAST({STRUCTURE.format(roof='roof_material_encoded', vent='vent_screened')} AS DOUBLE), 6) AS structure_points, round(CAST({EXPOSURE} AS DOUBLE), 6) AS exposure_points FROM scored")
def _(i):
    return S.score_components(encoded(i)).select("parcel_id", "terrain_points", "vegetation_points", "structure_points", "exposure_points")


@query("sco4_risk_category", f"{_W} SELECT {_CATEGORY} AS category, count(*) AS n FROM scored GROUP BY 1")
def _(i):
    return scored(i).groupBy(S.risk_category(F.col("wildfire_risk_score")).alias("category")).agg(F.count(F.lit(1)).alias("n"))


@query("sco5_composite_score", f"{_W} SELECT parcel_id, round(CAST(least(greatest(0.65 * s + 0.35 * {_FLOOD} + 0.0, 0), 100) AS DOUBLE), 6) AS composite FROM scored")
def _(i):
    return scored(i).select("parcel_id", S.composite_score(F.col("wildfire_risk_score"), S.flood_score(i.properties)).alias("composite"))


_USE = "CASE land_use WHEN 'academic' THEN 'educational' WHEN 'dormitory' THEN 'medical' ELSE land_use END"


@query("sco6_annual_loss", f"""{_W}, u AS (SELECT *, {_USE} AS raw_use FROM scored), v AS (SELECT *, CASE WHEN raw_use IN ('residential','educational','medical') THEN raw_use ELSE 'residential' END AS use FROM u)
 SELECT parcel_id, round(y0 + (y1 - y0) * (s - lo) / (hi - lo), 6) AS loss_pct, round((y0 + (y1 - y0) * (s - lo) / (hi - lo)) * assessed_value, 6) AS loss_usd
 FROM v JOIN loss_segments l ON l.use_type = v.use AND s >= lo AND (s < hi OR (hi = 100 AND s = 100))""")
def _(i):
    use = F.when(F.col("land_use") == "academic", "educational").when(F.col("land_use") == "dormitory", "medical").otherwise(F.col("land_use"))
    return S.annual_loss(scored(i).withColumn("use_type", use), i.loss_segments).select("parcel_id", "loss_pct", "loss_usd")


@query("sco7_risk_percentile", f"{_W} SELECT parcel_id, round(100.0 * percent_rank() OVER (ORDER BY round(s, 6)), 6) AS risk_percentile FROM scored")
def _(i):
    return S.risk_percentile(scored(i).withColumn("wildfire_risk_score", F.round("wildfire_risk_score", 6))).select("parcel_id", "risk_percentile")


@query("sco8_train_risk_model")
def _(i):
    df = scored(i).withColumn("label", F.col("wildfire_risk_score") / 100)
    fit = F.pmod(F.xxhash64("parcel_id"), F.lit(100)) < 85
    return S.model_metrics(S.train_risk_model(df.where(fit), "label"), df.where(~fit), "label")


@query("sco9_model_score")
def _(i):
    df = scored(i).withColumn("label", F.col("wildfire_risk_score") / 100)
    return S.model_score(S.train_risk_model(df, "label"), df).select("parcel_id", "model_score")


@query("sco9_tree_table", f"""WITH RECURSIVE {_W[5:]}, w(parcel_id, tree, node, k) AS (SELECT parcel_id, t.tree, 0, 0 FROM encoded CROSS JOIN (SELECT DISTINCT tree FROM trees) t UNION ALL
 SELECT w.parcel_id, w.tree, CASE WHEN coalesce(CASE t.feature {" ".join(f"WHEN '{f}' THEN CAST(e.{f} AS DOUBLE)" for f in S.MODEL_FEATURES)} END, 0) <= t.threshold THEN t."left" ELSE t."right" END, w.k + 1 FROM w JOIN trees t ON t.tree = w.tree AND t.node = w.node JOIN encoded e ON e.parcel_id = w.parcel_id WHERE t.feature IS NOT NULL)
 SELECT w.parcel_id, round(least(greatest(100 * sum(t.value), 0), 100), 6) AS model_score FROM w JOIN trees t ON t.tree = w.tree AND t.node = w.node WHERE t.feature IS NULL GROUP BY 1""")
def _(i):
    """Scores of an ensemble given as a table of nodes."""
    df = encoded(i)
    return df.select("parcel_id", S.tree_score(i.trees.withColumn("weight", F.lit(1.0))).alias("model_score"))


@query("sco10_feature_importance")
def _(i):
    df = scored(i).withColumn("label", F.col("wildfire_risk_score") / 100)
    return S.feature_importance(S.train_risk_model(df, "label"), i.spark)


# --- attributions --------------------------------------------------------------------------

_LONG = f"{_W}, enc AS (SELECT parcel_id, " + ", ".join(f"CAST({n} AS DOUBLE) AS {n}" for n in S.MODEL_FEATURES) + " FROM encoded), long AS (UNPIVOT enc ON " + ", ".join(S.MODEL_FEATURES) + " INTO NAME feature VALUE value)"
_ATT = _LONG + ", att AS (SELECT l.parcel_id, l.feature, l.value, f.category, f.controllable, f.label, round(l.value * f.weight, 2) AS contribution FROM long l JOIN features f ON f.feature = l.feature)"


def attributions(i: Inputs):
    return A.attribute_linear(encoded(i), i.features)


def attributed(i: Inputs):
    """Scored properties with their attributions, dealt evenly: one task reads a whole row group of the file."""
    return A.attributed(S.wildfire_score(i.properties.hint("rebalance")), i.features)


@query("att1_attribute_linear", f"{_ATT} SELECT parcel_id, feature, round(value, 6) AS value, contribution FROM att")
def _(i):
    return attributions(i).select("parcel_id", "feature", "value", "contribution")


@query("att2_attribute_vs_background", f"{_LONG} SELECT parcel_id, feature, round((value - avg(value) OVER (PARTITION BY feature)) * 0.5, 6) AS contribution FROM long")
def _(i):
    return A.attribute_vs_background(encoded(i), encoded(i)).select("parcel_id", "feature", "contribution")


@query("att3_attribution_rows", f"{_ATT} SELECT parcel_id, feature, label, category, controllable, round(value, 6) AS value, contribution FROM att")
def _(i):
    return attributions(i).select("parcel_id", "feature", "label", "category", "controllable", "value", "contribution")


@query("att4_additive_attribution", f"""{_W}, p AS (SELECT parcel_id, CAST({TERRAIN} AS DOUBLE) AS terrain, CAST({VEGETATION.format(z1='zone1_fuel_load', z2='zone2_fuel_load', ladder='ladder_fuel_present')} AS DOUBLE) AS vegetation, CAST({STRUCTURE.format(roof='roof_material_encoded', vent='vent_screened')} AS DOUBLE) AS structure, CAST({EXPOSURE} AS DOUBLE) AS exposure FROM scored),
 q AS (UNPIVOT p ON terrain, vegetation, structure, exposure INTO NAME part VALUE points) SELECT parcel_id, part, round(points, 6) AS points, round(points - avg(points) OVER (PARTITION BY part), 6) AS contribution FROM q""")
def _(i):
    return A.additive_attribution(encoded(i)).select("parcel_id", "part", "points", "contribution")


_CONTROL = "round(sum(CASE WHEN contribution > 0 AND controllable THEN contribution ELSE 0 END), 6) AS controllable_points, round(sum(CASE WHEN contribution > 0 AND NOT controllable THEN contribution ELSE 0 END), 6) AS fixed_points"


@query("att5_controllable_points", f"{_ATT} SELECT parcel_id, {_CONTROL} FROM att GROUP BY parcel_id")
def _(i):
    return A.controllable_points(attributed(i))


_RISKS = "row_number() OVER (PARTITION BY parcel_id ORDER BY abs(contribution) DESC, feature)"


@query("att6_top_risks", f"{_ATT} SELECT parcel_id, feature, contribution, CAST({_RISKS} AS INT) AS rank FROM att QUALIFY rank <= 5")
def _(i):
    return A.top_risks(attributed(i)).select("parcel_id", "feature", "contribution", "rank")


@query("att7_top_mitigations", f"{_ATT} SELECT parcel_id, feature, contribution, CAST(row_number() OVER (PARTITION BY parcel_id ORDER BY contribution DESC, feature) AS INT) AS rank FROM att WHERE controllable AND contribution > 0 QUALIFY rank <= 3")
def _(i):
    return A.top_mitigations(attributed(i)).select("parcel_id", "feature", "contribution", "rank")


@query("att8_portfolio_mitigations", f"{_ATT} SELECT label, round(sum(contribution), 6) AS total, count(*) AS properties, round(sum(contribution) / count(*), 6) AS mean FROM att WHERE controllable AND contribution > 0 GROUP BY label ORDER BY sum(contribution) DESC, label LIMIT 5")
def _(i):
    return A.portfolio_mitigations(attributions(i))


@query("att9_attribution_summary", f"""{_ATT}, r AS (SELECT *, {_RISKS} AS rank FROM att QUALIFY rank <= 3)
 SELECT parcel_id, string_agg(label || ' ' || CASE WHEN contribution < 0 THEN '' ELSE '+' END || printf('%.2f', contribution + 0.0), '; ' ORDER BY rank) AS summary FROM r GROUP BY parcel_id""")
def _(i):
    return A.attribution_summary(attributed(i))


@query("att10_waterfall_rows", f"""{_ATT}, r AS (SELECT *, {_RISKS} AS rank FROM att QUALIFY rank <= 5)
 SELECT parcel_id, feature, round(10 + coalesce(sum(contribution) OVER (PARTITION BY parcel_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 6) AS left_edge,
 round(10 + sum(contribution) OVER (PARTITION BY parcel_id ORDER BY rank), 6) AS right_edge FROM r""")
def _(i):
    return A.waterfall_rows(attributed(i), 10.0).select("parcel_id", "feature", "left_edge", "right_edge")


@query("att11_feature_metadata", "SELECT f.category, f.controllable, count(DISTINCT f.feature) AS features, count(*) AS uses FROM features f JOIN properties p ON f.category <> p.land_use GROUP BY 1, 2")
def _(i):
    return i.properties.select("land_use").join(F.broadcast(i.features), F.col("category") != F.col("land_use")).groupBy("category", "controllable").agg(F.count_distinct("feature").alias("features"), F.count(F.lit(1)).alias("uses"))


# --- mitigations ---------------------------------------------------------------------------

_ROOF_OF = _case("{r}", dims.ROOF_CLASS, 2)
_NEW = score_sql(z1="coalesce(set_z1, zone1_fuel_load)", z2="(zone2_fuel_load * z2_mult)", ladder="(CASE WHEN clears_ladder THEN 0 ELSE ladder_fuel_present END)", roof=f"(CASE WHEN set_roof IS NOT NULL THEN {_ROOF_OF.format(r='set_roof')} ELSE roof_material_encoded END)", vent="(CASE WHEN set_vent IS NOT NULL THEN 1 ELSE vent_screened END)")
_ACT = f"{_W}, act AS (SELECT scored.*, a.action, a.cost_low, a.cost_high, set_roof, set_vent, set_z1, z2_mult, cap_z3c, clears_ladder, s AS before, {_NEW} AS after FROM scored CROSS JOIN actions a)"


@query("mit1_action_catalog", "SELECT a.category, count(*) AS uses, sum(cost_low) AS cost_low, sum(cost_high) AS cost_high FROM actions a CROSS JOIN properties p GROUP BY 1")
def _(i):
    return i.properties.crossJoin(F.broadcast(i.actions)).groupBy("category").agg(F.count(F.lit(1)).alias("uses"), F.sum("cost_low").alias("cost_low"), F.sum("cost_high").alias("cost_high"))


@query("mit2_apply_action", f"""{_ACT} SELECT parcel_id, action, round(CAST(coalesce(set_z1, zone1_fuel_load) AS DOUBLE), 6) AS new_z1, round(CAST(zone2_fuel_load * z2_mult AS DOUBLE), 6) AS new_z2,
 round(CAST(least(zone3_fuel_continuity, coalesce(cap_z3c, 1e9)) AS DOUBLE), 6) AS new_z3_continuity, CAST(CASE WHEN clears_ladder THEN 0 ELSE ladder_fuel_present END AS DOUBLE) AS new_ladder FROM act""")
def _(i):
    return M.apply_action(encoded(i), i.actions).select("parcel_id", "action", "new_z1", "new_z2", "new_z3_continuity", "new_ladder")


@query("mit3_rank_mitigations", f"{_ACT} SELECT parcel_id, action, round(before - after, 6) AS points, CAST(row_number() OVER (PARTITION BY parcel_id ORDER BY round(before - after, 9) DESC, action) AS INT) AS priority_rank FROM act WHERE before - after > 0")
def _(i):
    return M.rank_mitigations(encoded(i), i.actions).select("parcel_id", "action", "points", "priority_rank")


KEYS = ["clear_zone1_combustibles", "no_such_action", "reduce_zone2_fuels", "replace_zone1_mulch_with_gravel", "screen_all_vents"]
_SEQ = f"""{_W}, k AS (SELECT unnest([{", ".join(f"'{k}'" for k in KEYS)}]) AS action, unnest(range({len(KEYS)})) AS pos), st AS (SELECT scored.*, k.pos, a.* EXCLUDE (category) FROM scored CROSS JOIN k JOIN actions a ON a.action = k.action),
 cum AS (SELECT *, row_number() OVER w AS step, last_value(set_z1 IGNORE NULLS) OVER w AS c_z1, last_value(set_vent IGNORE NULLS) OVER w AS c_vent, product(z2_mult) OVER w AS c_z2, bool_or(clears_ladder) OVER w AS c_ladder, last_value(set_roof IGNORE NULLS) OVER w AS c_roof FROM st WINDOW w AS (PARTITION BY parcel_id ORDER BY pos)),
 seq AS (SELECT *, {score_sql(z1="coalesce(c_z1, zone1_fuel_load)", z2="(zone2_fuel_load * c_z2)", ladder="(CASE WHEN c_ladder THEN 0 ELSE ladder_fuel_present END)", roof=f"(CASE WHEN c_roof IS NOT NULL THEN {_ROOF_OF.format(r='c_roof')} ELSE roof_material_encoded END)", vent="(CASE WHEN c_vent IS NOT NULL THEN 1 ELSE vent_screened END)")} AS after FROM cum)"""


def sequence(i: Inputs):
    return M.counterfactual_sequence(encoded(i), i.actions, F.array(*(F.lit(k) for k in KEYS)))


@query("mit4_counterfactual_sequence", f"{_SEQ} SELECT parcel_id, CAST(step AS INT) AS step, action, round(coalesce(lag(after) OVER (PARTITION BY parcel_id ORDER BY step), s), 6) AS before, round(after, 6) AS after FROM seq")
def _(i):
    return sequence(i).select("parcel_id", "step", "action", "before", "after")


@query("mit5_mitigation_metrics", f"""{_ACT}, d AS (SELECT *, before - after AS d FROM act) SELECT parcel_id, action, round(100 * d / greatest(before, 0.01), 6) AS pct, round(d * 0.3, 6) AS minutes_gained, round(CAST(least(d / 30, 0.5) AS DOUBLE), 6) AS survival_gain,
 CASE WHEN d <= 0 THEN 'N/A' ELSE '$' || format('{{:,}}', CAST(round_even(cost_low / d, 0) AS BIGINT)) END AS cost_per_point_low FROM d""")
def _(i):
    both = M.apply_action(encoded(i), i.actions).withColumn("before", S.rule_score()).withColumn("after", M.changed_score(F.col("set_roof"), F.col("set_vent"), F.col("set_z1"), F.col("z2_mult"), F.col("clears_ladder")))
    return M.with_metrics(both).select("parcel_id", "action", "pct", "minutes_gained", "survival_gain", "cost_per_point_low")


@query("mit6_mitigation_total", f"{_SEQ} SELECT parcel_id, round(s, 6) AS original, round(arg_max(after, step), 6) AS mitigated, round(CASE WHEN s <= 0 THEN 0 ELSE (s - arg_max(after, step)) / s * 100 END, 6) AS total_pct FROM seq GROUP BY parcel_id, s")
def _(i):
    return M.mitigation_total(sequence(i)).select("parcel_id", "original", "mitigated", "total_pct")


@query("mit7_before_after_rows", f"""{_ACT}, r AS (SELECT parcel_id, CAST(row_number() OVER (PARTITION BY parcel_id ORDER BY round(before - after, 9) DESC, action) AS INT) AS priority_rank, action, before, after FROM act WHERE before - after > 0)
 SELECT parcel_id, priority_rank, action, round(before, 6) AS before, round(after, 6) AS after, round(before - after, 6) AS difference FROM r WHERE priority_rank <= 8""")
def _(i):
    return M.before_after_rows(M.rank_mitigations(encoded(i), i.actions))


# --- requests --------------------------------------------------------------------------------


@query("qry1_assess", f"""{_ATT}, t AS (SELECT *, {_RISKS} AS rank FROM att QUALIFY rank <= 5), d AS (SELECT parcel_id, string_agg(feature, ',' ORDER BY rank) AS drivers FROM t GROUP BY 1),
 m0 AS (SELECT *, row_number() OVER (PARTITION BY parcel_id ORDER BY contribution DESC, feature) AS rank FROM att WHERE controllable AND contribution > 0 QUALIFY rank <= 3), m AS (SELECT parcel_id, string_agg(feature, ',' ORDER BY rank) AS helps FROM m0 GROUP BY 1)
 SELECT r.request_id, r.parcel_id, round(s, 6) AS wildfire_risk_score, {_CATEGORY} AS risk_category, round(x.slope_degrees, 6) AS slope, drivers, helps FROM requests r JOIN scored x ON x.parcel_id = r.parcel_id LEFT JOIN d ON d.parcel_id = r.parcel_id LEFT JOIN m ON m.parcel_id = r.parcel_id""")
def _(i):
    out = L.assess(i.requests, attributed(i))
    names = lambda c: F.array_join(F.transform(c, lambda x: x["feature"]), ",")
    return out.select("request_id", "parcel_id", "wildfire_risk_score", "risk_category", F.col("terrain.slope_degrees").alias("slope"), names("top_risk_drivers").alias("drivers"), names("top_mitigations").alias("helps"))


@query("qry2_resolve_property", """WITH r AS (SELECT request_id, CASE WHEN request_id % 2 = 0 THEN parcel_id END AS parcel_id, 'UNIT ' || CAST(request_id % 97 AS VARCHAR) AS text FROM requests), i AS (SELECT r.request_id, p.parcel_id AS resolved_id FROM r JOIN properties p ON p.parcel_id = r.parcel_id),
 o AS (SELECT r.request_id, min(p.parcel_id) AS resolved_id FROM r LEFT JOIN properties p ON contains(lower(concat_ws(' ', p.address, p.name)), lower(r.text)) WHERE r.request_id NOT IN (SELECT request_id FROM i) GROUP BY 1) SELECT * FROM i UNION ALL SELECT * FROM o""")
def _(i):
    text = F.concat(F.lit("UNIT "), (F.col("request_id") % 97).cast("string"))
    return L.resolve_property(i.requests.select("request_id", F.when(F.col("request_id") % 2 == 0, F.col("parcel_id")).alias("parcel_id"), text.alias("text")), i.properties)


@query("qry3_explain", f"""{_ATT}, c AS (SELECT parcel_id, {_CONTROL} FROM att GROUP BY 1), f AS (SELECT *, {_RISKS} AS rank FROM att), a AS (SELECT parcel_id, string_agg(feature || '=' || printf('%.2f', contribution + 0.0), ',' ORDER BY rank) AS attributions, max(CASE WHEN rank = 1 THEN label END) AS main_driver, max(CASE WHEN rank = 1 THEN contribution END) AS main_contribution FROM f GROUP BY 1)
 SELECT x.parcel_id, round(s, 6) AS wildfire_risk_score, 50.0::DOUBLE AS base_value, controllable_points, fixed_points, attributions, main_driver, main_contribution, 'Risk score ' || printf('%.1f', round(round(s, 9), 1)) || '/100. Controllable: ' || printf('%.1f', round(round(controllable_points, 9), 1)) || ' pts. Top action: ' || main_driver || '.' AS summary FROM scored x JOIN c ON c.parcel_id = x.parcel_id JOIN a ON a.parcel_id = x.parcel_id""")
def _(i):
    said = F.array_join(F.transform("attributions", lambda a: F.concat(a["feature"], F.lit("="), F.format_string("%.2f", a["contribution"] + 0.0))), ",")
    out = L.explain(attributed(i))
    return out.select("parcel_id", "wildfire_risk_score", "base_value", "controllable_points", "fixed_points", said.alias("attributions"), "main_driver", "main_contribution", "summary")


@query("qry4_mitigate", f"""{_SEQ}, sb AS (SELECT *, coalesce(lag(after) OVER (PARTITION BY parcel_id ORDER BY step), s) AS before FROM seq), se AS (SELECT parcel_id, arg_max(after, step) AS mitigated FROM seq GROUP BY 1), sk AS (SELECT *, before - after AS d, row_number() OVER (PARTITION BY parcel_id ORDER BY round(before - after, 9) DESC, step) AS n FROM sb)
 SELECT r.request_id, r.parcel_id, CAST(step AS INT) AS step, action, round(before, 6) AS before, round(after, 6) AS after, round(d, 6) AS points, round(100 * d / greatest(before, 0.01), 6) AS pct, round(d * 0.3, 6) AS minutes_gained, CAST(n AS INT) AS priority_rank, CASE WHEN d <= 0 THEN 'N/A–N/A' ELSE '$' || format('{{:,}}', CAST(round_even(cost_low / d, 0) AS BIGINT)) || '–$' || format('{{:,}}', CAST(round_even(cost_high / d, 0) AS BIGINT)) END AS cost_per_risk_point, round(mitigated, 6) AS mitigated, round(CASE WHEN s <= 0 THEN 0 ELSE (s - mitigated) / s * 100 END, 6) AS total_pct
 FROM requests r JOIN sk ON sk.parcel_id = r.parcel_id JOIN se ON se.parcel_id = r.parcel_id""")
def _(i):
    return L.mitigate(i.requests, sequence(i)).select("request_id", "parcel_id", "step", "action", "before", "after", "points", "pct", "minutes_gained", "priority_rank", "cost_per_risk_point", "mitigated", "total_pct")


OVERVIEW_SQL = f"""{_W}, b AS (SELECT parcel_id, s FROM scored WHERE is_owner_flagged ORDER BY round(s, 9) DESC, parcel_id LIMIT 10)
 SELECT count(*) AS total_properties, count(*) FILTER (is_owner_flagged) AS flagged_properties, round(coalesce(avg(s) FILTER (is_owner_flagged AND s > 0), 0), 6) AS mean_wildfire_risk, count(*) FILTER (is_owner_flagged AND s > 55) AS high_risk_count,
 count(*) FILTER (is_owner_flagged AND s > 75) AS very_high_risk_count, (SELECT string_agg(parcel_id, ',' ORDER BY round(s, 9) DESC, parcel_id) FROM b) AS highest_risk_properties FROM scored"""


@query("qry5_overview", OVERVIEW_SQL)
def overview(i):
    return L.overview(scored(i))


@query("qry6_validate_requests", """WITH r AS (SELECT *, CAST(request_id % 400 AS DOUBLE) AS dir, CAST(request_id % 110 AS DOUBLE) AS fwi, request_id % 260 AS mins, request_id % 104 AS runs, request_id % 1100 AS sims FROM requests) SELECT request_id, CASE WHEN parcel_id IS NULL THEN 'missing parcel_id' WHEN ignition_lat IS NULL OR NOT ignition_lat BETWEEN 35.5 AND 36.5 THEN 'latitude' WHEN ignition_lon IS NULL OR NOT ignition_lon BETWEEN -79.5 AND -78.5 THEN 'longitude'
 WHEN wind_speed_mph IS NULL OR NOT wind_speed_mph BETWEEN 0 AND 60 THEN 'wind speed' WHEN NOT dir BETWEEN 0 AND 360 THEN 'wind direction' WHEN NOT fwi BETWEEN 0 AND 100 THEN 'fire weather index' WHEN NOT mins BETWEEN 5 AND 240 THEN 'minutes' WHEN NOT runs BETWEEN 1 AND 100 THEN 'runs' WHEN NOT sims BETWEEN 10 AND 1000 THEN 'assessment runs' END AS reason FROM r""")
def _(i):
    k = F.col("request_id")
    asked = i.requests.withColumns({"wind_direction_degrees": (k % 400).cast("double"), "fire_weather_index": (k % 110).cast("double"), "max_time_minutes": k % 260, "n_simulations": k % 104, "n_assessments": k % 1100})
    return L.validate_requests(asked).select("request_id", "reason")


_FLAT = VEGETATION.format(z1="zone1_fuel_load", z2="zone2_fuel_load", ladder="ladder_fuel_present")
_DRIVER = f"(SELECT x.label FROM (VALUES ({STRUCTURE.format(roof='roof_material_encoded', vent='vent_screened')} / 35.0, 0, 'structural vulnerabilities'), ({_FLAT} / 30.0, 1, 'surrounding vegetation'), ({TERRAIN} / 25.0, 2, 'terrain characteristics'), ({EXPOSURE} / 10.0, 3, 'exposure to neighboring structures')) x(v, o, label) ORDER BY round(x.v, 9) DESC, x.o LIMIT 1)"


@query("qry7_narrative", f"""{_W}, d AS (SELECT *, {_DRIVER} AS driver, coalesce(nullif(name, ''), nullif(address, ''), parcel_id) AS title FROM scored) SELECT parcel_id, concat_ws(' ',
 CASE WHEN s < 30 THEN title || ' has relatively low wildfire risk.' WHEN s < 55 THEN title || ' faces moderate wildfire risk, primarily driven by ' || driver || '.' WHEN s < 75 THEN title || ' has elevated wildfire risk. The main concern is ' || driver || '.' ELSE title || ' is at serious wildfire risk, with ' || driver || ' as the primary driver.' END,
 CASE WHEN roof_material LIKE '%wood%' OR roof_material LIKE '%shake%' THEN 'Its wood roof is highly combustible and vulnerable to ember ignition.' WHEN roof_material LIKE '%asphalt%' THEN 'Asphalt shingles provide moderate fire resistance but can ignite under sustained ember exposure.' WHEN roof_material LIKE '%metal%' THEN 'Its metal roof offers strong fire resistance.' WHEN roof_material LIKE '%slate%' OR roof_material LIKE '%tile%' THEN 'Its slate/tile roof is highly fire-resistant, though embers can enter through gaps.' WHEN roof_material LIKE '%membrane%' OR roof_material LIKE '%flat%' THEN 'Its flat membrane roof has good fire resistance but is susceptible to pooling debris ignition.' WHEN roof_material LIKE '%built%' OR roof_material LIKE '%tar%' THEN 'Its built-up roof provides moderate fire resistance.' END,
 CASE vent_screening_status WHEN 'unscreened' THEN 'Unscreened vents could allow embers to enter the attic.' WHEN 'partial' THEN 'Partially screened vents reduce but don''t eliminate ember intrusion risk.' END,
 CASE WHEN slope_degrees > 10 THEN 'A steep ' || CAST(CAST(floor(slope_degrees + 0.5) AS INT) AS VARCHAR) || '° slope accelerates fire spread toward the structure.' WHEN slope_degrees > 5 THEN 'Moderate slope (' || CAST(CAST(floor(slope_degrees + 0.5) AS INT) AS VARCHAR) || '°) contributes to fire spread.' END,
 CASE WHEN tpi_class IN ('ridge', 'upper_slope') THEN 'Its elevated position on a ridge increases flame and ember exposure.' END, CASE WHEN ladder_fuel_present > 0 THEN 'Ladder fuels nearby could carry ground fire into the canopy.' END, CASE WHEN heat_load_index > 0.4 THEN 'Dense canopy cover (' || CAST(CAST(floor(heat_load_index * 100 + 0.5) AS INT) AS VARCHAR) || '%) creates continuous fuel overhead.' END,
 CASE WHEN stories > 2 AND building_sf / 1000 < 5 THEN 'In worst-case conditions, fire would reach this building in under ' || CAST(CAST(ceil(building_sf / 1000) AS INT) AS VARCHAR) || ' minutes.' WHEN stories > 2 THEN 'Simulated fire arrival is ' || CAST(CAST(floor(building_sf / 1000 + 0.5) AS INT) AS VARCHAR) || ' minutes under worst-case conditions.' END,
 CASE WHEN ember_exposure_probability > 0.7 THEN 'Ember exposure probability is high — firebrands from upwind fuel sources pose a significant ignition risk.' END) AS narrative FROM d""")
def _(i):
    more = scored(i).withColumn("canopy_cover_pct", F.col("heat_load_index") * 100).withColumn("fire_arrival_min", F.when(F.col("stories") > 2, F.col("building_sf") / 1000))
    return L.narrative(more)


@query("qry8_display_names", "SELECT parcel_id, coalesce(nullif(name, ''), nullif(address, ''), parcel_id) AS title, array_to_string(list_transform(string_split(roof_material, '_'), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS roof FROM properties")
def _(i):
    return i.properties.select("parcel_id", L.display_name().alias("title"), L.titled(F.col("roof_material")).alias("roof"))


@query("qry9_map_rows", f"{_W} SELECT parcel_id, coalesce(nullif(name, ''), nullif(address, ''), parcel_id) AS title, {_CATEGORY} AS category, round(s, 6) AS wildfire_risk_score, CASE WHEN year_built > 0 THEN CAST(year_built AS INT) END AS year, round(cx - half, 6) AS x0, round(cy - half, 6) AS y0, round(cx + half, 6) AS x1, round(cy + half, 6) AS y1, name, address, round(slope_degrees, 6) AS slope_degrees, round(heat_load_index, 6) AS heat_load_index, tpi_class, round(zone1_fuel_load, 6) AS zone1_fuel_load, round(zone2_fuel_load, 6) AS zone2_fuel_load, round(zone3_fuel_load, 6) AS zone3_fuel_load, roof_material, vent_screening_status, round(building_sf, 6) AS building_sf, round(neighbor_distance_m, 6) AS neighbor_distance_m, neighbor_distance_m < 15 AS neighbor_flag_15m, round(ember_exposure_probability, 6) AS ember_exposure_probability, is_owner_flagged FROM scored")
def _(i):
    rows = L.map_rows(scored(i))
    return rows.select("parcel_id", "title", "category", "wildfire_risk_score", "year", "x0", "y0", "x1", "y1", "name", "address", "slope_degrees", "heat_load_index", "tpi_class", "zone1_fuel_load", "zone2_fuel_load", "zone3_fuel_load", "roof_material", "vent_screening_status", "building_sf", "neighbor_distance_m", "neighbor_flag_15m", "ember_exposure_probability", "is_owner_flagged")


@query("qry9_map_bounds", "SELECT min(cx - half) AS x0, min(cy - half) AS y0, max(cx + half) AS x1, max(cy + half) AS y1, (min(cx - half) + max(cx + half)) / 2 AS x, (min(cy - half) + max(cy + half)) / 2 AS y FROM properties")
def _(i):
    return L.map_bounds(L.map_rows(scored(i)))


@query("agg10_stats_row", f"{_W} SELECT count(*) AS buildings, round(avg(s), 6) AS mean_risk, round(max(s), 6) AS max_risk, round(min(s), 6) AS min_risk, count(*) FILTER (s >= 55) AS high, count(*) FILTER (s >= 30 AND s < 55) AS moderate, count(*) FILTER (s < 30) AS low FROM scored")
def _(i):
    return L.stats_row(scored(i))
