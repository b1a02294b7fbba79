"""Queries of fire, embers, drainage, floods, footprints and validation, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from perilframe.functions import geometry as geo
from perilframe.operators import fire as X
from perilframe.operators import grid as G
from perilframe.operators import hydrology as H
from perilframe.operators import properties as P
from perilframe.operators import validation as Q
from perilframe.operators import weather as W
from perilframe.plans.registry import query

RES = 20.0
_CLASS = "CASE (row + col) % 4 WHEN 0 THEN 'valley' WHEN 1 THEN 'mid_slope' WHEN 2 THEN 'upper_slope' ELSE 'ridge' END"


def _classed(i):
    return i.fuel_cells.withColumn("tpi_class", F.expr(_CLASS))


_WIND = "{speed} * coalesce(multiplier, 1) * least(greatest(1 + 0.3 * cos(radians(aspect_deg - {dir})) * sin(radians(slope_deg)), 0.5), 2)"


@query("wnd1_terrain_wind", f"WITH c AS (SELECT *, {_CLASS} AS tpi_class FROM fuel_cells) SELECT row, col, round({_WIND.format(speed=20, dir=225)}, 6) AS wind_mph FROM c LEFT JOIN wind_multiplier m ON m.tpi_class = c.tpi_class")
def _(i):
    return X.terrain_wind(_classed(i), i.wind_multiplier, F.lit(20.0), F.lit(225.0)).select("row", "col", "wind_mph")


@query("wnd2_wind_fields", f"WITH c AS (SELECT *, {_CLASS} AS tpi_class FROM fuel_cells) SELECT bin_dir, bin_speed, count(*) AS cells, round(avg({_WIND.format(speed='bin_speed', dir='bin_dir')}), 5) AS mean_mph FROM c LEFT JOIN wind_multiplier m ON m.tpi_class = c.tpi_class CROSS JOIN wind_bins GROUP BY 1, 2")
def _(i):
    return X.wind_fields(_classed(i), i.wind_multiplier, i.wind_bins).groupBy("bin_dir", "bin_speed").agg(F.count(F.lit(1)).alias("cells"), F.round(F.avg("wind_mph"), 5).alias("mean_mph"))


_REQ = "SELECT request_id, CAST(request_id * 37 % 360 AS DOUBLE) AS wind_dir, CAST(5 + request_id % 40 AS DOUBLE) AS wind_speed FROM requests"


@query("wnd3_snap_wind", f"WITH r AS ({_REQ}), k AS (SELECT r.*, bin_dir, bin_speed, row_number() OVER (PARTITION BY request_id ORDER BY least(abs(wind_dir - bin_dir), 360 - abs(wind_dir - bin_dir)), abs(wind_speed - bin_speed), ord) AS n FROM r CROSS JOIN wind_bins) SELECT request_id, bin_dir, bin_speed, round(wind_speed / bin_speed, 6) AS scale FROM k WHERE n = 1")
def _(i):
    r = i.requests.select("request_id", (F.col("request_id") * 37 % 360).cast("double").alias("wind_dir"), (5 + F.col("request_id") % 40).cast("double").alias("wind_speed"))
    return X.snap_wind(r, i.wind_bins).select("request_id", "bin_dir", "bin_speed", "scale")


@query("wnd4_uniform_wind", "SELECT request_id, coalesce(CASE WHEN request_id % 3 = 0 THEN wind_speed_mph END, 12.0) AS mph FROM requests")
def _(i):
    return i.requests.select("request_id", X.uniform_wind(F.when(F.col("request_id") % 3 == 0, F.col("wind_speed_mph")), F.lit(12.0)).alias("mph"))


# --- fire -----------------------------------------------------------------------------------

_TERMS = """SELECT code, model, delta, mx, sigma, h, w1 * 2000 / 43560 AS a1, w10 * 2000 / 43560 AS a10, w100 * 2000 / 43560 AS a100, (w1 + w10 + w100) * 2000 / 43560 AS wd, (w1 + w10 + w100 + lh + lw) * 2000 / 43560 AS w FROM fuel_models"""
_FIRE = f"""WITH t0 AS ({_TERMS}), t1 AS (SELECT *, w / greatest(delta, 0.01) AS rho, w / greatest(delta, 0.01) / 32 AS beta, 3.348 * pow(sigma, -0.8189) AS opt, 133 * pow(sigma, -0.7913) AS ea FROM t0 WHERE delta > 0 AND sigma > 0 AND w >= 1e-6),
 t2 AS (SELECT *, pow(sigma, 1.5) / (495 + 0.0594 * pow(sigma, 1.5)) * pow(beta / opt, ea) * exp(ea * (1 - beta / opt)) AS gam, exp((0.792 + 0.681 * sqrt(sigma)) * (beta + 0.1)) / (192 + 0.2595 * sigma) AS xi FROM t1),
 s AS (SELECT scenario, wind_mph, wind_dir, m1, m1 * 1.3 AS m10, 0.1 AS m100 FROM scenarios),
 f0 AS (SELECT c.row, c.col, c.fbfm40, c.slope_deg, s.*, t2.*, CAST(least((a1 * m1 + a10 * m10 + a100 * m100) / greatest(wd, 1e-8) / mx, 1) AS DOUBLE) AS rr FROM fuel_cells c CROSS JOIN s LEFT JOIN t2 ON t2.code = c.fbfm40),
 f1 AS (SELECT *, gam * w * (1 - 0.0555) * h * greatest(0, 1 - 2.59 * rr + 5.11 * rr * rr - 3.52 * rr * rr * rr) * 0.174 * pow(0.01, -0.19) AS ir,
  7.47 * exp(-0.133 * pow(sigma, 0.55)) * pow(wind_mph * 88 * 0.4, 0.02526 * pow(sigma, 0.54)) * pow(beta / opt, -0.715 * exp(-3.59e-4 * sigma)) AS pw, 5.275 * pow(beta, -0.3) * pow(tan(radians(slope_deg)), 2) AS ps FROM f0),
 f2 AS (SELECT *, coalesce(ir * xi * (1 + pw + ps) / (rho * exp(-138 / sigma) * (250 + 1116 * m1)), 0) AS rate FROM f1), f3 AS (SELECT *, coalesce(h * w * rate / 60, 0) AS i_b, CASE WHEN coalesce(h * w * rate / 60, 0) > 0 THEN 0.45 * pow(h * w * rate / 60, 0.46) ELSE 0 END AS flame_length FROM f2)"""


def _fire(i):
    return X.spread_rate(i.fuel_cells, i.fuel_models, W.moisture_from_1hr(i.scenarios))


@query("fire1_spread_rate", f"{_FIRE} SELECT row, col, scenario, round(rate, 6) AS rate, round(i_b, 5) AS i_b, round(flame_length, 6) AS flame_length, round(CASE WHEN rate > 0 THEN ir * delta / rate ELSE 0 END, 4) AS hpa FROM f3")
def _(i):
    return _fire(i).select("row", "col", "scenario", "rate", F.round("i_b", 5).alias("i_b"), "flame_length", F.round("hpa", 4).alias("hpa"))


@query("fire2_reaction_intensity", f"{_FIRE} SELECT row, col, scenario, round(coalesce(ir, 0), 5) AS i_r FROM f3")
def _(i):
    return _fire(i).select("row", "col", "scenario", F.round("i_r", 5).alias("i_r"))


@query("fire3_wind_coefficient", f"{_FIRE} SELECT row, col, scenario, round(coalesce(pw, 0), 6) AS phi_w FROM f3")
def _(i):
    return _fire(i).select("row", "col", "scenario", "phi_w")


@query("fire4_slope_coefficient", f"{_FIRE} SELECT row, col, scenario, round(coalesce(ps, 0), 6) AS phi_s FROM f3")
def _(i):
    return _fire(i).select("row", "col", "scenario", "phi_s")


@query("fire5_scenario_sweep", f"{_FIRE} SELECT scenario, count(*) AS cells, count(*) FILTER (rate > 0) AS burning, round(avg(rate), 5) AS mean_rate, round(max(flame_length), 5) AS max_flame FROM f3 GROUP BY 1")
def _(i):
    return _fire(i).groupBy("scenario").agg(F.count(F.lit(1)).alias("cells"), F.count_if(F.col("rate") > 0).alias("burning"), F.round(F.avg("rate"), 5).alias("mean_rate"), F.round(F.max("flame_length"), 5).alias("max_flame"))


_EDGES = """o AS (SELECT dr.dr, dc.dc, CASE WHEN dr.dr <> 0 AND dc.dc <> 0 THEN 20 * sqrt(2) ELSE 20.0 END AS dist, fmod(degrees(atan2(dc.dc, -dr.dr)) + 360, 360) AS bearing FROM unnest([-1, 0, 1]) dr(dr), unnest([-1, 0, 1]) dc(dc) WHERE NOT (dr.dr = 0 AND dc.dc = 0)),
 b AS (SELECT *, least(abs(bearing - 45), 360 - abs(bearing - 45)) AS off FROM o), e AS (SELECT f.row, f.col, f.row + dr AS row2, f.col + dc AS col2, dist / greatest(rate * 0.3048 * greatest(0.2, 1 + 0.5 * cos(radians(off))), 0.001) AS minutes FROM f3 f CROSS JOIN b WHERE f.scenario = 'worst' AND rate > 0 AND EXISTS (SELECT 1 FROM fuel_cells c WHERE c.row = f.row + dr AND c.col = f.col + dc))"""


def _edges(i):
    return X.travel_cost_edges(_fire(i).where("scenario = 'worst'").select("row", "col", "rate"), RES, 225.0)


@query("fire6_travel_cost_edges", f"{_FIRE}, {_EDGES} SELECT row, col, row2, col2, round(minutes, 5) AS minutes FROM e")
def _(i):
    return _edges(i).select("row", "col", "row2", "col2", F.round("minutes", 5).alias("minutes"))


#: Every cell's least arrival in each number of steps, until the budget ends all ways.
_REACH = f"""WITH RECURSIVE {_FIRE[5:]}, {_EDGES}, src AS (SELECT DISTINCT row * 50 + col AS source_id, row, col FROM e), r(k, source_id, row, col, t) AS (SELECT 0, source_id, row, col, 0.0::DOUBLE FROM src UNION ALL SELECT max(r.k) + 1, r.source_id, e.row2, e.col2, min(r.t + e.minutes) FROM r JOIN e ON e.row = r.row AND e.col = r.col WHERE r.t + e.minutes <= 4 GROUP BY r.source_id, e.row2, e.col2)
 SELECT source_id, row, col, round(min(t), 5) AS arrival FROM r GROUP BY 1, 2, 3"""


@query("fire7_reach_within_budget", _REACH)
def _(i):
    edges = _edges(i)
    sources = edges.select((F.col("row") * 50 + F.col("col")).alias("source_id"), "row", "col").distinct()
    return X.reach_within_budget(edges, sources, 4.0).select("source_id", "row", "col", F.round("arrival", 5).alias("arrival"))


@query("fire8_exposure_from_runs", "SELECT row, col, round(count(toa) / (SELECT count(DISTINCT run_id) FROM runs)::DOUBLE, 6) AS burn_probability, round(quantile_cont(CAST(toa AS DOUBLE), 0.5), 6) AS p50, round(quantile_cont(CAST(toa AS DOUBLE), 0.9), 6) AS p90 FROM runs GROUP BY 1, 2")
def _(i):
    return X.exposure_from_runs(i.runs)


@query("fire9_reach_summary", "SELECT run_id, count(toa) AS cells, round(count(toa) * 0.04, 6) AS hectares, round(max(CASE WHEN toa IS NOT NULL THEN intensity END), 6) AS max_intensity, CAST(max(toa) AS DOUBLE) AS max_arrival FROM runs GROUP BY 1")
def _(i):
    return X.reach_summary(i.runs, RES).withColumn("max_arrival", F.col("max_arrival").cast("double"))


@query("fire10_isochrone_bands", """WITH m AS (SELECT max(toa) AS most FROM runs), l AS (SELECT level FROM isochrones, m WHERE most > above AND most <= upto AND level <= 1.5 * most), b AS (SELECT run_id, row, col, min(level) AS level FROM runs JOIN l ON toa <= level WHERE toa IS NOT NULL GROUP BY 1, 2, 3)
 SELECT run_id, level, count(*) AS cells, round(count(*) * 0.04, 6) AS hectares, CASE WHEN level < 1 THEN CAST(CAST(level * 60 AS INT) AS VARCHAR) || ' sec' ELSE CAST(CAST(level AS INT) AS VARCHAR) || ' min' END AS label FROM b GROUP BY 1, 2""")
def _(i):
    return X.isochrone_bands(i.runs, i.isochrones, RES)


_SIDES = {"n": ("row", "col + (level - nw) / (ne - nw)", "(row * 2147483648 + col) * 2"), "s": ("row + 1", "col + (level - sw) / (se - sw)", "((row + 1) * 2147483648 + col) * 2"), "w": ("row + (level - nw) / (sw - nw)", "col", "(row * 2147483648 + col) * 2 + 1"), "e": ("row + (level - ne) / (se - ne)", "col + 1", "(row * 2147483648 + col + 1) * 2 + 1")}
_side = lambda by, k: f"CASE {by} " + " ".join(f"WHEN '{n}' THEN CAST({x[k]} AS {'BIGINT' if k == 2 else 'DOUBLE'})" for n, x in _SIDES.items()) + " END"
_QUADS = """g AS (SELECT run_id, CAST(row AS BIGINT) AS row, CAST(col AS BIGINT) AS col, coalesce(CAST(toa AS DOUBLE), 9999) AS v FROM runs), q AS (SELECT a.run_id, a.row, a.col, level, a.v AS nw, b.v AS ne, c.v AS sw, d.v AS se, CAST(a.v < level AS INT) * 8 + CAST(b.v < level AS INT) * 4 + CAST(d.v < level AS INT) * 2 + CAST(c.v < level AS INT) AS k
 FROM g a JOIN lv ON lv.run_id = a.run_id JOIN g b ON b.run_id = a.run_id AND b.row = a.row AND b.col = a.col + 1 JOIN g c ON c.run_id = a.run_id AND c.row = a.row + 1 AND c.col = a.col JOIN g d ON d.run_id = a.run_id AND d.row = a.row + 1 AND d.col = a.col + 1)"""
_PIECE = f"{_QUADS}, t(k, f, u) AS (VALUES {', '.join(f'({k}, {p[0]!r}, {p[1]!r})' for k, ps in X.PIECES.items() for p in ps)}), p AS (SELECT run_id, row, col, level, {_side('f', 2)} AS node, {_side('f', 1)} AS x1, {_side('f', 0)} AS y1, {_side('u', 2)} AS next, {_side('u', 1)} AS x2, {_side('u', 0)} AS y2 FROM q JOIN t ON t.k = q.k)"
_AT15 = "lv AS (SELECT DISTINCT run_id, 15.0::DOUBLE AS level FROM runs)"
_CHOSEN = "mx AS (SELECT run_id, max(CAST(toa AS DOUBLE)) AS most FROM runs GROUP BY 1), lv AS (SELECT run_id, level FROM mx JOIN isochrones ON most > above AND most <= upto AND level <= 1.5 * most)"
_ON = "p.run_id = w.run_id AND p.level = w.level AND p.node = w.node"
_LINES = f"""WITH RECURSIVE {_CHOSEN}, {_PIECE}, nd AS (SELECT run_id, level, node, x1 AS x, y1 AS y FROM p UNION SELECT run_id, level, next, x2, y2 FROM p), st AS (SELECT p.run_id, p.level, p.node FROM p ANTI JOIN p i ON i.run_id = p.run_id AND i.level = p.level AND i.next = p.node),
 walk(run_id, level, line, node, k) AS (SELECT run_id, level, node, node, 0 FROM st UNION ALL SELECT w.run_id, w.level, w.line, p.next, w.k + 1 FROM walk w JOIN p ON {_ON}),
 ring(run_id, level, line, node, k) AS (SELECT p.run_id, p.level, p.node, p.node, 0 FROM p ANTI JOIN walk v ON v.run_id = p.run_id AND v.level = p.level AND v.node = p.node UNION ALL SELECT w.run_id, w.level, w.line, p.next, w.k + 1 FROM ring w JOIN p ON {_ON} WHERE (w.k = 0 OR w.node <> w.line) AND p.next >= w.line),
 ln AS (SELECT *, false AS closed FROM walk UNION ALL SELECT w.*, true FROM ring w SEMI JOIN (SELECT run_id, level, line FROM ring WHERE k > 0 AND node = line) f ON f.run_id = w.run_id AND f.level = w.level AND f.line = w.line),
 lines AS (SELECT ln.run_id, ln.level, ln.line, ln.closed, ln.k, x, y FROM ln JOIN nd ON nd.run_id = ln.run_id AND nd.level = ln.level AND nd.node = ln.node QUALIFY max(ln.k) OVER (PARTITION BY ln.run_id, ln.level, ln.line, ln.closed) >= 2)"""


@query("fire11_isochrone_segments", f"WITH {_AT15}, {_PIECE} SELECT run_id, row, col, round(x1, 6) AS x1, round(y1, 6) AS y1, round(x2, 6) AS x2, round(y2, 6) AS y2 FROM p")
def _(i):
    """Every piece of each run's line at 15 minutes."""
    runs = i.runs.withColumn("toa", F.col("toa").cast("double"))
    return X.isochrone_segments(runs, 15.0, ("run_id",)).withColumn("row", F.col("row").cast("long")).withColumn("col", F.col("col").cast("long"))


def isochrones(i):
    runs = i.runs.withColumn("toa", F.col("toa").cast("double"))
    return X.isochrone_lines(runs, X.chosen_levels(runs, i.isochrones, ("run_id",)), ("run_id",))


@query("fire11_isochrone_lines", f"{_LINES} SELECT run_id, round(level, 6) AS level, line, closed, k, round(x, 6) AS x, round(y, 6) AS y FROM lines")
def _(i):
    """Every vertex of each run's lines, in order."""
    return isochrones(i).select("run_id", "level", "line", "closed", F.posexplode("points").alias("k", "p")).select("run_id", "level", "line", "closed", "k", "p.x", "p.y")


_PLACE = "SELECT parcel_id, CAST(floor(cx / 25) AS INT) AS row, CAST(floor(cy / 25) AS INT) AS col FROM properties"
_ONE = "SELECT row, col, CAST(toa AS DOUBLE) AS toa, intensity FROM runs WHERE run_id = 1"


def _places(i):
    return i.properties.select("parcel_id", F.floor(F.col("cx") / 25).cast("int").alias("row"), F.floor(F.col("cy") / 25).cast("int").alias("col"))


def _one_run(i, k=1):
    return i.runs.where(F.col("run_id") == k).select("row", "col", F.col("toa").cast("double").alias("toa"), "intensity")


@query("fire12_parcels_reached", f"WITH p AS ({_PLACE}), r AS ({_ONE}) SELECT w.m AS within, parcel_id FROM p JOIN r ON r.row = p.row AND r.col = p.col JOIN (VALUES (30), (60)) w(m) ON toa * 2 <= w.m")
def _(i):
    met = _places(i).join(_one_run(i), ["row", "col"]).select("parcel_id", (F.col("toa") * 2).alias("toa"))
    return X.parcels_reached(met)


@query("fire13_property_exposure", f"WITH p AS ({_PLACE}), r AS ({_ONE}), m AS (SELECT quantile_cont(toa, 0.5) AS med, avg(CASE WHEN intensity > 0 THEN intensity END) AS mean FROM r) SELECT p.parcel_id, round(coalesce(toa, med), 6) AS arrival_p50, round(coalesce(toa, med) * 1.3, 6) AS arrival_p90, round(least(1, coalesce(intensity, mean, 0) / 500), 6) AS ember_exposure FROM p CROSS JOIN m LEFT JOIN r ON r.row = p.row AND r.col = p.col")
def _(i):
    return X.property_exposure(_places(i), _one_run(i))


_LAUNCH = f"{_FIRE}, la AS (SELECT row, col, CAST(least(greatest(floor(5 * i_b / 500), 1), 50) AS INT) AS n_embers FROM f3 WHERE scenario = 'worst' AND flame_length >= 4)"


def _launch(i):
    return X.ember_launch_counts(_fire(i).where("scenario = 'worst'"))


@query("emb1_ember_launch_counts", f"{_LAUNCH} SELECT row, col, n_embers FROM la")
def _(i):
    return _launch(i).select("row", "col", "n_embers")


_DRAWS = "dr AS (SELECT k.k + 1 AS k, ln(u / (1 - u)) / 1.702 AS zd, ln(v / (1 - v)) / 1.702 AS za FROM (SELECT k.k, fmod((k.k + 0.5) * 0.754877666, 1) AS u, fmod((k.k + 0.5) * 0.569840291, 1) AS v FROM unnest(range(50)) k(k)) k)"
_LAND = f"{_LAUNCH}, {_DRAWS}, fl AS (SELECT row, col, exp(5.5 + 1.2 * zd) * (1 + 0.5 * (35 * 0.44704) / 10) AS dist, radians(45 + 20 * za) AS head FROM la JOIN dr ON dr.k <= n_embers), land AS (SELECT CAST(row - floor(dist * cos(head) / 20 + 0.5) AS INT) AS row, CAST(col + floor(dist * sin(head) / 20 + 0.5) AS INT) AS col FROM fl), em AS (SELECT row, col, count(*) AS embers FROM land WHERE row BETWEEN 0 AND 49 AND col BETWEEN 0 AND 49 GROUP BY 1, 2)"


def _landed(i):
    return X.ember_landing_counts(_launch(i), X.draws(i.spark), 35.0, 225.0 - 360, RES, 50, 50)


@query("emb2_ember_landing_counts", f"{_LAND} SELECT row, col, embers FROM em")
def _(i):
    return _landed(i)


@query("emb3_ignition_probability", f"{_LAND} SELECT c.row, c.col, round(1 - exp(-coalesce(embers, 0) * least(greatest(0.9 * exp(-4.3 * 0.04), 0), 1) * coalesce(receptivity, 0.7)), 6) AS p_ignition FROM fuel_cells c LEFT JOIN em ON em.row = c.row AND em.col = c.col LEFT JOIN receptivity r ON r.code = c.fbfm40")
def _(i):
    cells = i.fuel_cells.select("row", "col", "fbfm40").join(_landed(i), ["row", "col"], "left")
    return X.ignition_probability(cells, i.receptivity, 0.04).select("row", "col", "p_ignition")


@query("emb4_spotting_distance", f"{_FIRE} SELECT row, col, scenario, round(least(0.162 * pow(wind_mph * 0.44704, 2.2) * pow(flame_length * 0.3048, 0.6), 5000), 5) AS max_m, round(exp(5.5) * (wind_mph * 0.44704 / 10) * (flame_length * 0.3048 / 5), 5) AS probable_m FROM f3")
def _(i):
    d = X.spotting_distance(F.col("wind_mph"), F.col("flame_length"))
    return _fire(i).select("row", "col", "scenario", F.round(d["max_m"], 5).alias("max_m"), F.round(d["probable_m"], 5).alias("probable_m"))


# --- drainage -------------------------------------------------------------------------------

_DIRS = ", ".join(f"({k}, {dr}, {dc}, {1.414 if dr and dc else 1.0})" for k, (_, dr, dc) in enumerate(H.DIRECTIONS))
_D8 = f"""dirs(code, dr, dc, w) AS (VALUES {_DIRS}), dn AS (SELECT a.row, a.col, code, row_number() OVER (PARTITION BY a.row, a.col ORDER BY (a.z - b.z) / w DESC, code) AS k, a.row + dr AS row2, a.col + dc AS col2 FROM cells a CROSS JOIN dirs JOIN cells b ON b.row = a.row + dr AND b.col = a.col + dc WHERE a.z > b.z),
 dd AS (SELECT row, col, code, row2, col2 FROM dn WHERE k = 1)"""


def _grid(i):
    full = i.spark.range(2500).select(F.floor(F.col("id") / 50).cast("int").alias("row"), (F.col("id") % 50).cast("int").alias("col"))
    return full.join(i.cells.select("row", "col", "z"), ["row", "col"], "left")


@query("hyd2_d8_direction", f"WITH {_D8} SELECT c.row, c.col, coalesce(code, -1) AS direction FROM cells c LEFT JOIN dd ON dd.row = c.row AND dd.col = c.col")
def _(i):
    return H.d8_direction(_grid(i)).where("z is not null").select("row", "col", "direction")


_ACC = f"WITH RECURSIVE {_D8}, up(row, col, row2, col2) AS (SELECT row, col, row, col FROM cells UNION ALL SELECT up.row, up.col, dd.row2, dd.col2 FROM up JOIN dd ON dd.row = up.row2 AND dd.col = up.col2), ac AS (SELECT row2 AS row, col2 AS col, count(*) AS accumulation FROM up GROUP BY 1, 2)"


def _accumulated(i):
    return H.flow_accumulation(H.d8_direction(_grid(i)).where("z is not null"))


@query("hyd3_flow_accumulation", f"{_ACC} SELECT row, col, accumulation FROM ac")
def _(i):
    return _accumulated(i).select("row", "col", "accumulation")


@query("hyd4_stream_cells", f"{_ACC} SELECT accumulation > 8 AS stream, count(*) AS cells FROM ac GROUP BY 1")
def _(i):
    return _accumulated(i).groupBy(H.stream_cells(8).alias("stream")).agg(F.count(F.lit(1)).alias("cells"))


@query("hyd5_distance_to_stream", "SELECT a.row, a.col, round(20 * sqrt(min((a.row - b.row) * (a.row - b.row) + (a.col - b.col) * (a.col - b.col))), 6) AS distance_to_stream_m FROM cells a, cells b WHERE b.building = 1 AND (b.row + b.col) % 3 = 0 GROUP BY 1, 2")
def _(i):
    stream = F.coalesce((F.col("building") == 1) & ((F.col("row") + F.col("col")) % 3 == 0), F.lit(False))
    whole = _grid(i).join(i.cells.select("row", "col", "building"), ["row", "col"], "left")
    return H.distance_to_stream(whole, stream, RES).where("building is not null").select("row", "col", "distance_to_stream_m")


_HAND = f"""{_ACC}, z AS (SELECT ac.*, c.z, accumulation > 8 AS stream FROM ac JOIN cells c ON c.row = ac.row AND c.col = ac.col), dwn(row, col, row2, col2) AS (SELECT row, col, row, col FROM z UNION ALL SELECT w.row, w.col, dd.row2, dd.col2 FROM dwn w JOIN z ON z.row = w.row2 AND z.col = w.col2 AND NOT z.stream JOIN dd ON dd.row = w.row2 AND dd.col = w.col2),
 hit AS (SELECT w.row, w.col, greatest(a.z - b.z, 0) AS h FROM dwn w JOIN z a ON a.row = w.row AND a.col = w.col JOIN z b ON b.row = w.row2 AND b.col = w.col2 AND b.stream)"""


@query("hyd6_hand", f"{_HAND} SELECT z.row, z.col, round(coalesce(h, (SELECT coalesce(max(h), 100) FROM hit)), 9) AS hand_m FROM z LEFT JOIN hit ON hit.row = z.row AND hit.col = z.col", 9)
def _(i):
    return H.hand(_accumulated(i), H.stream_cells(8)).select("row", "col", "hand_m")


@query("hyd7_cti", "SELECT row, col, round(least(greatest(ln((1 + row + col) * 400.0 / tan(radians(greatest(slope_deg, 0.001)))), 0), 30), 6) AS cti FROM fuel_cells")
def _(i):
    from perilframe.operators.terrain import wetness

    return i.fuel_cells.select("row", "col", wetness(F.lit(1) + F.col("row") + F.col("col"), F.col("slope_deg"), RES).alias("cti"))


#: Relaxation from above, until long after nothing moves.
_FILL = """WITH RECURSIVE w AS (SELECT r.row, c.col, coalesce(CAST(k.z AS DOUBLE), 110.0) AS z, r.row IN (0, 49) OR c.col IN (0, 49) AS edge FROM (SELECT CAST(unnest(range(50)) AS INT) AS row) r CROSS JOIN (SELECT CAST(unnest(range(50)) AS INT) AS col) c LEFT JOIN cells k ON k.row = r.row AND k.col = c.col),
 o(dr, dc) AS (SELECT a.x, b.x FROM (VALUES (-1), (0), (1)) a(x) CROSS JOIN (VALUES (-1), (0), (1)) b(x) WHERE a.x <> 0 OR b.x <> 0), nb AS (SELECT w.row, w.col, w.row + dr AS row2, w.col + dc AS col2 FROM w CROSS JOIN o WHERE NOT w.edge),
 f(k, row, col, v) AS (SELECT 0, row, col, CASE WHEN edge THEN z ELSE 1e18 END FROM w UNION ALL SELECT max(x.k) + 1, w.row, w.col, CASE WHEN any_value(w.edge) THEN any_value(w.z) ELSE greatest(any_value(w.z), min(x.v) + {eps}) END FROM w LEFT JOIN nb ON nb.row = w.row AND nb.col = w.col JOIN f x ON x.row = coalesce(nb.row2, w.row) AND x.col = coalesce(nb.col2, w.col) WHERE x.k < 250 GROUP BY w.row, w.col)
 SELECT f.row, f.col, round(w.z, 6) AS z, round(f.v, 6) AS filled FROM f JOIN w ON w.row = f.row AND w.col = f.col WHERE f.k = 250"""


def _whole_grid(i):
    return _grid(i).withColumn("z", F.coalesce("z", F.lit(110.0)))


@query("hyd1_fill_depressions", _FILL.format(eps=1e-4))
def _(i):
    return H.fill_depressions(_whole_grid(i), eps=1e-4, tile=16).select("row", "col", "z", "filled")


@query("hyd1_flood_fill", _FILL.format(eps=0))
def _(i):
    return H.fill_depressions(_whole_grid(i), tile=16).select("row", "col", "z", "filled")


@query("hyd8_flow_features")
def _(i):
    cells = _grid(i).where("z is not null").join(i.fuel_cells.select("row", "col", "slope_deg"), ["row", "col"])
    return H.flow_features(cells, RES, 8).select("row", "col", "direction", "accumulation", "distance_to_stream_m", "hand_m", "cti")


# --- floods -----------------------------------------------------------------------------------

_FLOW = "SELECT p.period, q.cells, round(coalesce(a, 500) * pow(q.cells * 100 / (1609.34 * 1609.34), coalesce(b, 0.72)) * 0.0283168, 6) AS q_m3s FROM (SELECT DISTINCT n * 1000 AS cells FROM cells) q CROSS JOIN (SELECT unnest([2, 5, 10, 25, 50, 100, 500, 77]) AS period) p LEFT JOIN flood_regression f ON f.period = p.period"


@query("fld1_peak_flow", _FLOW)
def _(i):
    return H.peak_flow(i.cells.select((F.col("n") * 1000).alias("cells")).distinct(), i.flood_regression, (*H.PERIODS, 77))


@query("fld2_manning_depth", "SELECT row, col, round(CASE WHEN n - 3 <= 0 THEN 0 ELSE pow((n - 3) * 0.05 / (10 * sqrt(0.005)), 0.6) END, 6) AS depth FROM cells")
def _(i):
    return i.cells.select("row", "col", H.manning_depth((F.col("n") - 3).cast("double"), 10.0).alias("depth"))


_DEPTH = "WITH d AS (SELECT row, col, CAST((row * 3 + col) % 30 AS DOUBLE) / 10 AS hand_m FROM cells), r AS (SELECT period, ln(period) / 2 AS rise FROM flood_regression), x AS (SELECT d.*, period, CASE WHEN rise - hand_m > 0 THEN rise - hand_m END AS depth FROM d CROSS JOIN r)"


def _depths(i):
    d = i.cells.select("row", "col", (((F.col("row") * 3 + F.col("col")) % 30).cast("double") / 10).alias("hand_m"))
    return H.inundation_depth(d, i.flood_regression.select("period", (F.ln(F.col("period").cast("double")) / 2).alias("rise")))


@query("fld3_inundation_depth", f"{_DEPTH} SELECT row, col, period, round(depth, 6) AS depth FROM x")
def _(i):
    return _depths(i).select("row", "col", "period", "depth")


@query("fld4_flooded_area", f"{_DEPTH} SELECT period, count(depth) AS cells, round(count(depth) * 0.04, 6) AS hectares FROM x GROUP BY 1")
def _(i):
    return H.flooded_area(_depths(i), RES)


_PLACE20 = "SELECT parcel_id, CAST(floor(cx / 20) AS INT) AS row, CAST(floor(cy / 20.1) AS INT) AS col FROM properties"
_PDEP = f"{_DEPTH}, p AS ({_PLACE20}), w AS (SELECT parcel_id, " + ", ".join(f"coalesce(max(depth) FILTER (period = {k}), 0) AS d{k}" for k in (10, 25, 100)) + " FROM p LEFT JOIN x ON x.row = p.row AND x.col = p.col GROUP BY 1)"


def _parcel_depths(i):
    places = i.properties.select("parcel_id", F.floor(F.col("cx") / 20).cast("int").alias("row"), F.floor(F.col("cy") / 20.1).cast("int").alias("col"))
    return H.parcel_flood_depths(places, _depths(i))


@query("fld5_parcel_flood_depths", f"{_PDEP} SELECT parcel_id, round(d10, 6) AS depth_10yr, round(d25, 6) AS depth_25yr, round(d100, 6) AS depth_100yr FROM w")
def _(i):
    return _parcel_depths(i)


@query("fld6_flood_points", f"{_PDEP} SELECT parcel_id, round(CAST(least(100, CASE WHEN d100 > 0 THEN 30 + least(10 * d100, 20) ELSE 0 END + CASE WHEN d25 > 0 THEN 25 ELSE 0 END + CASE WHEN d10 > 0 THEN 25 ELSE 0 END) AS DOUBLE), 6) AS points FROM w")
def _(i):
    return _parcel_depths(i).select("parcel_id", H.flood_points().cast("double").alias("points"))


@query("fld7_flood_score", "SELECT parcel_id, round(CAST(least(greatest(greatest(0, (10 - hand_m) * 5) + greatest(0, (1000 - distance_to_stream_m) * 0.05) + least(cti * 2, 20) + CASE WHEN in_fema_100yr THEN 30 ELSE 0 END, 0), 100) AS DOUBLE), 6) AS flood_risk_score FROM properties")
def _(i):
    from perilframe.operators.scoring import flood_score

    return i.properties.select("parcel_id", flood_score(i.properties).alias("flood_risk_score"))


@query("fld8_roughness_by_cover", "WITH c AS (SELECT row, col, CASE (row + col) % 3 WHEN 0 THEN 'forest' WHEN 1 THEN 'grass' ELSE 'lava' END AS cover FROM cells) SELECT row, col, coalesce(n, 0.05) AS roughness FROM c LEFT JOIN roughness r ON r.cover = c.cover")
def _(i):
    cover = F.when((F.col("row") + F.col("col")) % 3 == 0, "forest").when((F.col("row") + F.col("col")) % 3 == 1, "grass").otherwise("lava")
    return H.roughness_by_cover(i.cells.select("row", "col", cover.alias("cover")), i.roughness).select("row", "col", "roughness")


# --- properties --------------------------------------------------------------------------------


def _ring():
    return geo.square(F.col("cx"), F.col("cy"), F.col("half"))


@query("prop1_standardize_parcels", "SELECT parcel_id, name AS owner_name, CAST(building_sf AS DOUBLE) AS building_sf FROM properties")
def _(i):
    raw = i.properties.select(F.col("parcel_id").alias("PARCELID"), F.col("name").alias("OwnerName"), F.col("building_sf").alias("TotalSqFt"))
    return P.standardize_parcels(raw)


@query("prop2_flag_owner", "SELECT parcel_id, coalesce(upper(CASE WHEN is_owner_flagged THEN NULL ELSE address END) LIKE '%CHINA%' OR upper(CASE WHEN is_owner_flagged THEN NULL ELSE address END) LIKE '%INDIA%', false) AS is_owner_flagged FROM properties")
def _(i):
    df = i.properties.select("parcel_id", F.when(F.col("is_owner_flagged"), F.lit(None)).otherwise(F.col("address")).alias("owner_name"))
    return P.flag_owner(df, ["china", "india"]).select("parcel_id", "is_owner_flagged")


def _ways(i):
    nodes = i.properties.select("parcel_id", F.posexplode(_ring()).alias("k", "p")).select(F.concat("parcel_id", F.lit("-"), F.col("k").cast("string")).alias("id"), F.col("p.x").alias("x"), F.col("p.y").alias("y"))
    corner = lambda k: F.concat("parcel_id", F.lit(f"-{k}"))
    few = F.col("half") == 3
    refs = F.when(few, F.array(corner(0), corner(1), corner(2))).otherwise(F.array(*(corner(k) for k in range(4))))
    return i.properties.select(F.col("parcel_id").alias("id"), refs.alias("nodes")), nodes


@query("prop3_assemble_footprints", "SELECT parcel_id AS id, round(4 * half * half, 6) AS area, round(cx, 6) AS x, round(cy, 6) AS y FROM properties WHERE half <> 3")
def _(i):
    out = P.assemble_footprints(*_ways(i))
    c = geo.centroid(F.col("ring"))
    return out.select("id", geo.area(F.col("ring")).alias("area"), c["x"].alias("x"), c["y"].alias("y"))


@query("prop4_footprint_attributes", "SELECT 'OSM_' || parcel_id AS parcel_id, CAST(CASE WHEN stories % 2 = 0 THEN stories ELSE 2 END AS INT) AS stories, address LIKE '%CHINA%' AS is_owner_flagged FROM properties")
def _(i):
    tags = F.create_map(F.lit("operator"), F.col("address"), F.lit("building:levels"), F.when(F.col("stories") % 2 == 0, F.concat(F.col("stories").cast("string"), F.lit(".0"))).otherwise(F.lit("many")))
    return P.footprint_attributes(i.properties.select(F.col("parcel_id").alias("id"), tags.alias("tags")), "China").select("parcel_id", "stories", "is_owner_flagged")


@query("prop5_footprint_area", "SELECT parcel_id, 4 * half * half AS area_m2, round(4 * half * half * 10.764, 6) AS building_sf FROM properties WHERE 4 * half * half > 40")
def _(i):
    return P.footprint_area(i.properties.select("parcel_id", _ring().alias("ring")), 40.0).drop("ring")


def _squares(i):
    """Centres and widths, dealt evenly: one task reads a whole row group of the file."""
    return i.properties.select("parcel_id", "cx", "cy", "half").hint("rebalance")


def _parts():
    """A square with a square hole, and a smaller square apart from it."""
    x, y, h = F.col("cx"), F.col("cy"), F.col("half")
    return F.array(geo.square(x, y, h / 2), geo.square(x, y, h), geo.square(x + 3 * h, y, h / 3))


@query("prop5_area_of_parts", "SELECT parcel_id, round(31.0 / 9 * half * half, 6) AS area_m2, round(31.0 / 9 * half * half * 10.764, 6) AS building_sf FROM properties WHERE 31.0 / 9 * half * half > 40")
def _(i):
    return P.footprint_area(_squares(i).select("parcel_id", _parts().alias("rings")), 40.0).drop("rings")


@query("prop7_within_parts", "WITH d AS (SELECT parcel_id, greatest(abs(cx - 400), abs(cy - 500)) AS d, greatest(abs(cx - 1000), abs(cy - 500)) AS e FROM properties) SELECT parcel_id FROM d WHERE (d < 200.5 AND d > 100.5) OR e < 66.5")
def _(i):
    square = lambda x, half: geo.square(F.lit(float(x)), F.lit(500.0), F.lit(half))
    return P.within_boundary(i.properties, F.array(square(400, 200.5), square(400, 100.5), square(1000, 66.5)), several=True).select("parcel_id")


@query("prop8_centroid_of_parts", "SELECT parcel_id, round((3 * cx + 4.0 / 9 * (cx + 3 * half)) / (31.0 / 9), 6) AS x, round(cy, 6) AS y FROM properties")
def _(i):
    c = geo.polygon_centroid(_parts())
    return _squares(i).select("parcel_id", F.explode(F.array(c)).alias("c")).select("parcel_id", "c.x", "c.y")  # once a row


@query("prop6_clip_bbox", "SELECT parcel_id FROM properties WHERE cx - half <= 500 AND cx + half >= 100 AND cy - half <= 600 AND cy + half >= 200")
def _(i):
    return P.clip_bbox(i.properties.select("parcel_id", _ring().alias("ring")), 100, 200, 500, 600).select("parcel_id")


@query("prop7_within_boundary", "SELECT parcel_id FROM properties WHERE cy > 100.5 AND cy < 900.5 AND cx > 100.25 AND cx < 100.25 + (cy - 100.5)")
def _(i):
    corner = lambda x, y: F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"))
    return P.within_boundary(i.properties, F.array(corner(100.25, 100.5), corner(900.25, 900.5), corner(100.25, 900.5))).select("parcel_id")


@query("prop8_centroid", "SELECT parcel_id, round(cx, 6) AS x, round(cy, 6) AS y FROM properties")
def _(i):
    c = geo.centroid(_ring())
    return i.properties.select("parcel_id", c["x"].alias("x"), c["y"].alias("y"))


@query("prop9_twin_identity", "SELECT parcel_id, coalesce(name, '') AS name, coalesce(nullif(year_built, 0), 1975) AS year_built, coalesce(nullif(stories, 0), 1) AS stories, round(coalesce(nullif(assessed_value, 0), 0), 6) AS assessed_value FROM properties")
def _(i):
    return P.twin_identity(i.properties).drop("building_sf")


_YEAR = "CASE WHEN year_built IN (0, 1975) OR CAST(parcel_id AS INT) % 2 = 0 THEN CASE WHEN land_use IN ('church','chapel') THEN 1932 WHEN land_use IN ('dormitory','residential') THEN 1925 + k % 50 WHEN land_use IN ('university','academic') THEN 1930 + k % 60 WHEN stories >= 3 OR building_sf > 15000 THEN 1950 + k % 40 WHEN building_sf < 2000 THEN 1960 + k % 40 ELSE 1940 + k % 50 END ELSE year_built END"
_INFER = f"WITH k AS (SELECT *, CAST(('0x' || substr(md5(parcel_id), 1, 8)) AS BIGINT) % 100 AS k FROM properties), y AS (SELECT * EXCLUDE (year_built), CAST({_YEAR} AS INT) AS year_built FROM k)"


def _inferred(i):
    unknown = i.properties.withColumn("year_built", F.when(F.col("parcel_id").cast("int") % 2 == 0, 0).otherwise(F.col("year_built")))
    return P.infer_year(unknown)


@query("prop10_infer_year", f"{_INFER} SELECT parcel_id, year_built FROM y")
def _(i):
    return _inferred(i).select("parcel_id", "year_built")


@query("prop11_infer_roof", f"""{_INFER} SELECT parcel_id, CASE WHEN land_use IN ('church','chapel') THEN 'slate_tile' WHEN stories >= 4 OR building_sf > 20000 THEN 'membrane_flat' WHEN stories >= 3 OR building_sf > 8000 THEN 'built_up_tar' WHEN land_use IN ('garage','shed','service') THEN 'metal' WHEN year_built < 1940 THEN 'slate_tile' ELSE 'asphalt_shingles' END AS roof_material,
 CAST(CASE WHEN land_use IN ('church','chapel') THEN 0.6 WHEN stories >= 4 OR building_sf > 20000 THEN 0.7 WHEN stories >= 3 OR building_sf > 8000 THEN 0.5 WHEN land_use IN ('garage','shed','service') THEN 0.6 WHEN year_built < 1940 THEN 0.4 ELSE 0.5 END AS DOUBLE) AS roof_material_confidence FROM y""")
def _(i):
    return P.infer_roof(_inferred(i)).select("parcel_id", "roof_material", "roof_material_confidence")


@query("prop12_infer_vents", f"{_INFER} SELECT parcel_id, CASE WHEN year_built >= 2000 THEN 'screened' WHEN year_built >= 1970 THEN 'partial' ELSE 'unscreened' END AS vents FROM y")
def _(i):
    return _inferred(i).select("parcel_id", P.infer_vents(F.col("year_built")).alias("vents"))


@query("prop13_attach_terrain", "SELECT parcel_id, round(coalesce(c.slope_deg, 0), 6) AS slope_deg, round(coalesce(c.aspect_deg, 0), 6) AS aspect_deg FROM properties p LEFT JOIN fuel_cells c ON c.row = CAST(least(greatest(floor((1001.0 - cy) / 20.0), 0), 49) AS INT) AND c.col = CAST(least(greatest(floor(cx / 20.0), 0), 49) AS INT)")
def _(i):
    return G.sample_nearest(i.properties.select("parcel_id", "cx", "cy"), i.fuel_cells, {"slope_deg": 0.0, "aspect_deg": 0.0}, 0.0, 1001.0, RES, 50, 50).select("parcel_id", "slope_deg", "aspect_deg")


@query("prop14_attach_vegetation", "SELECT parcel_id, round(greatest(0, (coalesce(c.z, 0) / 200 - 0.1) / 0.5 * 100), 6) AS canopy_cover_pct FROM properties p LEFT JOIN cells c ON c.row = CAST(least(greatest(floor((1001.0 - cy) / 20.0), 0), 49) AS INT) AND c.col = CAST(least(greatest(floor(cx / 20.0), 0), 49) AS INT)")
def _(i):
    s = G.sample_nearest(i.properties.select("parcel_id", "cx", "cy"), i.cells, {"z": 0.0}, 0.0, 1001.0, RES, 50, 50)
    return s.select("parcel_id", P.canopy_from_ndvi(F.col("z") / 200).alias("canopy_cover_pct"))


_TWIN_CELL = "SELECT parcel_id, CAST(least(greatest(floor((1001.0 - cy) / 20.0), 0), 49) AS INT) AS row, CAST(least(greatest(floor(cx / 20.0), 0), 49) AS INT) AS col FROM properties"


@query("prop15_build_twins", f"{_DEPTH}, p AS ({_PLACE20}), w AS (SELECT parcel_id, max(depth) FILTER (period = 100) AS d FROM p JOIN x ON x.row = p.row AND x.col = p.col GROUP BY 1), g AS ({_TWIN_CELL}), one AS ({_ONE}), f AS ({_PLACE}), m AS (SELECT quantile_cont(toa, 0.5) AS med, avg(CASE WHEN intensity > 0 THEN intensity END) AS mean FROM one) SELECT q.parcel_id, q.county, round(coalesce(w.d, 0), 6) AS depth_100yr, round(coalesce(t.slope_deg, 0), 6) AS slope_deg, round(coalesce(t.aspect_deg, 0), 6) AS aspect_deg, round(greatest(0, (coalesce(c.z, 0) / 200 - 0.1) / 0.5 * 100), 6) AS canopy_cover_pct, round(coalesce(one.toa, med), 6) AS arrival_p50, round(coalesce(one.toa, med) * 1.3, 6) AS arrival_p90, round(least(1, coalesce(one.intensity, mean, 0) / 500), 6) AS ember_exposure FROM properties q CROSS JOIN m LEFT JOIN w ON w.parcel_id = q.parcel_id LEFT JOIN g ON g.parcel_id = q.parcel_id LEFT JOIN fuel_cells t ON t.row = g.row AND t.col = g.col LEFT JOIN cells c ON c.row = g.row AND c.col = g.col LEFT JOIN f ON f.parcel_id = q.parcel_id LEFT JOIN one ON one.row = f.row AND one.col = f.col")
def _(i):
    """Properties with terrain, vegetation, fire and flood layers."""
    at = i.properties.select("parcel_id", "cx", "cy")
    terrain = G.sample_nearest(at, i.fuel_cells, {"slope_deg": 0.0, "aspect_deg": 0.0}, 0.0, 1001.0, RES, 50, 50).select("parcel_id", "slope_deg", "aspect_deg")
    vegetation = G.sample_nearest(at, i.cells, {"z": 0.0}, 0.0, 1001.0, RES, 50, 50).select("parcel_id", P.canopy_from_ndvi(F.col("z") / 200).alias("canopy_cover_pct"))
    layers = {"terrain": terrain, "vegetation": vegetation, "fire": X.property_exposure(_places(i), _one_run(i)), "flood": _parcel_depths(i)}
    return P.build_twins(i.properties, layers, {"depth_100yr": 0.0}).select("parcel_id", "county", "depth_100yr", "slope_deg", "aspect_deg", "canopy_cover_pct", "arrival_p50", "arrival_p90", "ember_exposure")


# --- proximity -----------------------------------------------------------------------------------

_ZC = "WITH b AS (SELECT parcel_id, cx, cy, half FROM properties), c AS (SELECT row, col, (col + 0.5) * 5 AS x, (row + 0.5) * 5 AS y, CAST((row + col) % 7 AS DOUBLE) AS load, CASE (row + 2 * col) % 4 WHEN 0 THEN 'TU1' WHEN 1 THEN 'GR1' WHEN 2 THEN 'SH5' ELSE 'TL1' END AS model, CAST(row % 6 AS DOUBLE) AS canopy_height FROM pixels), d AS (SELECT b.parcel_id, c.*, sqrt(pow(greatest(0, abs(x - cx) - half), 2) + pow(greatest(0, abs(y - cy) - half), 2)) AS d FROM b JOIN c ON abs(x - cx) <= half + 30.5 AND abs(y - cy) <= half + 30.5), z AS (SELECT *, CASE WHEN d <= 0 THEN NULL WHEN d <= 1.5 THEN 1 WHEN d <= 9 THEN 2 WHEN d <= 30.5 THEN 3 END AS zone FROM d)"


def _buildings(i):
    return i.properties.select("parcel_id", _ring().alias("ring"))


def _fuel_spots(i):
    kind = F.when((F.col("row") + 2 * F.col("col")) % 4 == 0, "TU1").when((F.col("row") + 2 * F.col("col")) % 4 == 1, "GR1").when((F.col("row") + 2 * F.col("col")) % 4 == 2, "SH5").otherwise("TL1")
    return i.pixels.select("row", "col", ((F.col("col") + 0.5) * 5).alias("x"), ((F.col("row") + 0.5) * 5).alias("y"), ((F.col("row") + F.col("col")) % 7).cast("double").alias("load"), kind.alias("model"), (F.col("row") % 6).cast("double").alias("canopy_height"))


def _measured(i, buildings):
    cells = _fuel_spots(i)
    return P.once_a_shape(buildings, lambda b: P.zone_metrics(b, P.zone_cells(b, cells)))


@query("prx1_zone_rings", f"{_ZC} SELECT parcel_id, zone, count(*) AS cells FROM z WHERE zone IS NOT NULL GROUP BY 1, 2")
def _(i):
    cells = _fuel_spots(i)
    return P.once_a_shape(_buildings(i), lambda b: P.zone_cells(b, cells).groupBy("parcel_id", "zone").agg(F.count(F.lit(1)).alias("cells")))


_ZM = {
    "prx2_zone_fuel_load": ("zone1_fuel_load, zone2_fuel_load, zone3_fuel_load", ", ".join(f"round(coalesce(avg(load) FILTER (zone = {k}), 0), 6) AS zone{k}_fuel_load" for k in (1, 2, 3))),
    "prx3_zone2_canopy": ("zone2_canopy", "round(coalesce(avg(canopy_height) FILTER (zone = 2), 0), 6) AS zone2_canopy"),
    "prx4_zone_dominant_fuel": ("zone2_dominant_fuel", "coalesce((SELECT arg_min(m.model, (-m.n, m.model)) FROM (SELECT parcel_id, model, count(*) AS n FROM z WHERE zone = 2 GROUP BY 1, 2) m WHERE m.parcel_id = b.parcel_id), 'NB9') AS zone2_dominant_fuel"),
    "prx5_zone_ladder_fuel": ("ladder_fuel_present", "coalesce(bool_or(model IN ('TU1','TU5','SH1','SH5','SH9','GR3','GR4')) FILTER (zone = 2) AND avg(canopy_height) FILTER (zone = 2) > 2, false) AS ladder_fuel_present"),
    "prx6_zone3_continuity": ("zone3_fuel_continuity", "round(coalesce(avg(CASE WHEN load > 0 THEN 1.0 ELSE 0.0 END) FILTER (zone = 3), 0), 6) AS zone3_fuel_continuity"),
}
for _name, (_columns, _sql) in _ZM.items():
    query(_name, f"{_ZC} SELECT b.parcel_id, {_sql} FROM b LEFT JOIN z ON z.parcel_id = b.parcel_id GROUP BY b.parcel_id")(lambda i, c=_columns: _measured(i, _buildings(i)).select("parcel_id", *c.split(", ")))

_NEAR = "WITH n AS (SELECT a.parcel_id, min(sqrt(pow(greatest(0, abs(a.cx - b.cx) - a.half - b.half), 2) + pow(greatest(0, abs(a.cy - b.cy) - a.half - b.half), 2))) AS d FROM properties a JOIN properties b ON b.parcel_id <> a.parcel_id GROUP BY 1)"


@query("prx7_neighbor_distance", f"{_NEAR} SELECT parcel_id, round(d, 6) AS neighbor_distance_m FROM n")
def _(i):
    return P.neighbor_distance(_buildings(i))


@query("prx8_neighbor_flag", f"{_NEAR} SELECT count(*) FILTER (d < 15) AS flagged, round(avg(CASE WHEN d < 15 THEN 1.0 ELSE 0.0 END), 6) AS share FROM n")
def _(i):
    f = P.neighbor_flag(F.col("neighbor_distance_m"))
    return P.neighbor_distance(_buildings(i)).agg(F.count_if(f).alias("flagged"), F.avg(f.cast("double")).alias("share"))


@query("prx9_empty_zone_record", f"{_ZC} SELECT b.parcel_id, CASE WHEN CAST(b.parcel_id AS INT) % 5 <> 1 THEN round(coalesce(avg(load) FILTER (zone = 1), 0), 6) END AS zone1_fuel_load, CASE WHEN CAST(b.parcel_id AS INT) % 5 = 1 THEN 'unknown' ELSE coalesce((SELECT arg_min(m.model, (-m.n, m.model)) FROM (SELECT parcel_id, model, count(*) AS n FROM z WHERE zone = 2 GROUP BY 1, 2) m WHERE m.parcel_id = b.parcel_id), 'NB9') END AS zone2_dominant_fuel, CAST(b.parcel_id AS INT) % 5 <> 1 AND {_ZM['prx5_zone_ladder_fuel'][1]} FROM b LEFT JOIN z ON z.parcel_id = b.parcel_id GROUP BY b.parcel_id")
def _(i):
    """Every property, one in five without a footprint."""
    some = i.properties.select("parcel_id", F.when(F.col("parcel_id").cast("int") % 5 != 1, _ring()).alias("ring"))
    return _measured(i, some).select("parcel_id", "zone1_fuel_load", "zone2_dominant_fuel", "ladder_fuel_present")


_REPORT = ", ".join(x[1] for x in _ZM.values())


@query("prx10_proximity_report", f"{_ZC}, {_NEAR[5:]} SELECT b.parcel_id, {_REPORT}, round(any_value(n.d), 6) AS neighbor_distance_m, any_value(n.d) < 15 AS neighbor_flag_15m FROM b LEFT JOIN z ON z.parcel_id = b.parcel_id JOIN n ON n.parcel_id = b.parcel_id GROUP BY b.parcel_id")
def _(i):
    return P.proximity_report(_buildings(i), _fuel_spots(i))


# --- validation -----------------------------------------------------------------------------------

_AB = "WITH a AS (SELECT row, col, CAST(toa AS DOUBLE) AS toa FROM runs WHERE run_id = 1), b AS (SELECT row, col, CAST(toa AS DOUBLE) AS toa FROM runs WHERE run_id = 2), j AS (SELECT a.toa AS x, b.toa AS y FROM a FULL JOIN b ON a.row = b.row AND a.col = b.col)"


@query("val1_sorensen", f"{_AB} SELECT round(2.0 * count(*) FILTER (x IS NOT NULL AND y IS NOT NULL) / (count(x) + count(y)), 6) AS sorensen FROM j")
def _(i):
    return Q.sorensen(_one_run(i, 1), _one_run(i, 2))


@query("val2_arrival_correlation", f"{_AB} SELECT round(corr(x, y), 6) AS r FROM j")
def _(i):
    return Q.arrival_correlation(_one_run(i, 1), _one_run(i, 2))


@query("val3_area_difference", f"{_AB} SELECT round(1.0 * count(*) FILTER ((x IS NOT NULL) <> (y IS NOT NULL)) / count(y), 6) AS area_difference FROM j")
def _(i):
    return Q.area_difference(_one_run(i, 1), _one_run(i, 2))


@query("val4_calibration_curve", "SELECT CAST(floor(slope_degrees / 10) AS INT) AS bin, count(*) AS n, round(avg(slope_degrees), 6) AS predicted, round(avg(ember_exposure_probability), 6) AS observed FROM properties GROUP BY 1")
def _(i):
    return Q.calibration_curve(i.properties, "slope_degrees", "ember_exposure_probability")


@query("val5_within_stratum_variance", "WITH s AS (SELECT county, count(*) AS n, var_pop(slope_degrees) AS v FROM properties GROUP BY 1) SELECT round(sum(n * v) / sum(n) / (SELECT var_pop(slope_degrees) FROM properties), 6) AS within_share FROM s")
def _(i):
    return Q.within_stratum_variance(i.properties, "slope_degrees", "county")

