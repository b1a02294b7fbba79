"""Wind on terrain, fire behaviour, spread and embers of cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from perilframe import dims
from perilframe.operators.chains import list_ranks
from perilframe.operators.iterate import stored
from perilframe.operators.quantiles import exact_percentiles
from perilframe.operators.reach import reach_within_budget  # noqa: F401  part of this module's interface

_ST, _SE, _RHO = 0.0555, 0.010, 32.0

# --- wind ---------------------------------------------------------------------------------


def terrain_wind(cells: DataFrame, multiplier: DataFrame, speed: Column, direction: Column) -> DataFrame:
    """cells with wind_mph: speed by terrain class, aspect and slope."""
    turn = 1 + 0.3 * F.cos(F.radians(F.col("aspect_deg") - direction)) * F.sin(F.radians("slope_deg"))
    out = cells.join(F.broadcast(multiplier), "tpi_class", "left")
    return out.withColumn("wind_mph", speed * F.coalesce("multiplier", F.lit(1.0)) * F.least(F.greatest(turn, F.lit(0.5)), F.lit(2.0))).drop("multiplier")


def wind_fields(cells: DataFrame, multiplier: DataFrame, bins: DataFrame) -> DataFrame:
    """Every cell's wind for each of 24 bins of direction and speed."""
    return terrain_wind(cells.crossJoin(F.broadcast(bins)), multiplier, F.col("bin_speed"), F.col("bin_dir"))


def snap_wind(requests: DataFrame, bins: DataFrame) -> DataFrame:
    """requests (wind_dir, wind_speed) with the nearest bin, the first of ties, and the scale actual / bin; a row for each row."""
    every = bins.agg(F.collect_list(F.struct("bin_dir", "bin_speed", "ord")).alias("_bins"))  # 24 bins in one row
    off = lambda b: F.abs(F.col("wind_dir") - b["bin_dir"])
    key = lambda b: F.struct(F.least(off(b), 360 - off(b)).alias("a"), F.abs(F.col("wind_speed") - b["bin_speed"]).alias("b"), b["ord"].alias("ord"), b["bin_dir"].alias("bin_dir"), b["bin_speed"].alias("bin_speed"))
    best = requests.crossJoin(F.broadcast(every)).withColumn("_k", F.array_min(F.transform("_bins", key)))
    return best.select(*requests.columns, F.col("_k.bin_dir").alias("bin_dir"), F.col("_k.bin_speed").alias("bin_speed"), (F.col("wind_speed") / F.col("_k.bin_speed")).alias("scale"))


def uniform_wind(scaled: Column, speed: Column) -> Column:
    return F.coalesce(scaled, speed)


# --- behaviour ------------------------------------------------------------------------------


def fuel_terms(models: DataFrame) -> DataFrame:
    """What depends on fuel alone, once for each model."""
    c = F.col
    loads = {n: c(n) * 2000 / 43560 for n in ("w1", "w10", "w100", "lh", "lw")}
    step = models.withColumns({f"l_{n}": x for n, x in loads.items()})
    step = step.withColumn("w_dead", c("l_w1") + c("l_w10") + c("l_w100")).withColumn("w_all", c("w_dead") + c("l_lh") + c("l_lw"))
    step = step.withColumn("burns", (c("delta") > 0) & (c("sigma") > 0) & (c("w_all") >= 1e-6)).withColumn("s", F.greatest("sigma", F.lit(1.0))).withColumn("d", F.greatest("delta", F.lit(0.01)))
    step = step.withColumn("rho_b", c("w_all") / c("d")).withColumn("beta", F.greatest(c("rho_b") / _RHO, F.lit(1e-9))).withColumn("ratio", c("beta") / (3.348 * F.pow("s", F.lit(-0.8189))))
    s15, a = F.pow("s", F.lit(1.5)), 133 * F.pow("s", F.lit(-0.7913))
    step = step.withColumn("gamma", s15 / (495 + 0.0594 * s15) * F.pow("ratio", a) * F.exp(a * (1 - c("ratio"))))
    step = step.withColumn("xi", F.exp((0.792 + 0.681 * F.sqrt("s")) * (c("beta") + 0.1)) / (192 + 0.2595 * c("s"))).withColumn("eps", F.exp(-138 / c("s")))
    return step.withColumn("wc", 7.47 * F.exp(-0.133 * F.pow("s", F.lit(0.55)))).withColumn("wb", 0.02526 * F.pow("s", F.lit(0.54))).withColumn("we", 0.715 * F.exp(-3.59e-4 * c("s")))


_TERMS = ["l_w1", "l_w10", "l_w100", "w_dead", "w_all", "burns", "delta", "mx", "h", "rho_b", "beta", "ratio", "gamma", "xi", "eps", "wc", "wb", "we"]


def reaction_intensity() -> Column:
    """Over fuel terms and the moistures m1, m10, m100."""
    c = F.col
    m = (c("l_w1") * c("m1") + c("l_w10") * c("m10") + c("l_w100") * c("m100")) / F.greatest(c("w_dead"), F.lit(1e-8))
    r = F.least(m / c("mx"), F.lit(1.0))
    damp = F.greatest(F.lit(0.0), 1 - 2.59 * r + 5.11 * r * r - 3.52 * r * r * r)
    return c("gamma") * c("w_all") * (1 - _ST) * c("h") * damp * (0.174 * _SE**-0.19)


def wind_coefficient(mph: Column) -> Column:
    u = mph * 88 * 0.4
    return F.when(u > 0, F.col("wc") * F.pow(F.greatest(u, F.lit(1e-9)), "wb") * F.pow("ratio", -F.col("we"))).otherwise(0.0)


def slope_coefficient(slope: Column) -> Column:
    t = F.tan(F.radians(slope))
    return 5.275 * F.pow("beta", F.lit(-0.3)) * t * t


def spread_rate(cells: DataFrame, models: DataFrame, scenarios: DataFrame) -> DataFrame:
    """cells x scenarios with rate of spread (ft/min), fireline intensity, flame length, heat per area.

    cells has fbfm40 and slope_deg; a scenario has wind_mph and m1, m10, m100. Cells that don't burn,
    and unknown codes, are 0.
    """
    c = F.col
    terms = fuel_terms(models).select(F.col("code").alias("fbfm40"), *_TERMS)
    df = cells.join(F.broadcast(terms), "fbfm40", "left").crossJoin(F.broadcast(scenarios))
    on = lambda x: F.when(F.coalesce("burns", F.lit(False)), x).otherwise(0.0)
    df = df.withColumn("i_r", on(reaction_intensity())).withColumn("phi_w", on(wind_coefficient(c("wind_mph")))).withColumn("phi_s", on(slope_coefficient(c("slope_deg"))))
    df = df.withColumn("rate", on(c("i_r") * c("xi") * (1 + c("phi_w") + c("phi_s")) / (c("rho_b") * c("eps") * (250 + 1116 * c("m1")))))
    df = df.withColumn("i_b", on(c("h") * c("w_all") * c("rate") / 60)).withColumn("flame_length", F.when(c("i_b") > 0, 0.45 * F.pow(F.greatest("i_b", F.lit(1e-12)), F.lit(0.46))).otherwise(0.0))
    return df.withColumn("hpa", F.when(c("rate") > 0, c("i_r") * c("delta") / c("rate")).otherwise(0.0)).drop(*_TERMS)


# --- spread -----------------------------------------------------------------------------------

_OFFSETS = [(-1, -1), (-1, 0), (-1, 1), (0, -1), (0, 1), (1, -1), (1, 0), (1, 1)]


def travel_cost_edges(cells: DataFrame, res: float, wind_dir: float) -> DataFrame:
    """(row, col, row2, col2, minutes) from every burning cell to its neighbours in the grid; cells has rate (ft/min)."""
    rows = []
    for dr, dc in _OFFSETS:
        rows.append(F.struct(F.lit(dr).alias("dr"), F.lit(dc).alias("dc"), F.lit(res * (2**0.5 if dr and dc else 1.0)).alias("dist")))
    steps = cells.where("rate > 0").select("row", "col", "rate", F.explode(F.array(*rows)).alias("o"))
    bearing = F.pmod(F.degrees(F.atan2(F.col("o.dc").cast("double"), -F.col("o.dr").cast("double"))), F.lit(360.0))
    off = F.abs(bearing - (wind_dir + 180) % 360)
    off = F.when(off > 180, 360 - off).otherwise(off)
    speed = F.col("rate") * 0.3048 * F.greatest(F.lit(0.2), 1 + 0.5 * F.cos(F.radians(off)))
    edges = steps.select("row", "col", (F.col("row") + F.col("o.dr")).alias("row2"), (F.col("col") + F.col("o.dc")).alias("col2"), (F.col("o.dist") / F.greatest(speed, F.lit(0.001))).alias("minutes"))
    return edges.join(cells.select(F.col("row").alias("row2"), F.col("col").alias("col2")), ["row2", "col2"], "left_semi").select("row", "col", "row2", "col2", "minutes")


def exposure_from_runs(runs: DataFrame) -> DataFrame:
    """(row, col): the share of all runs that reach a cell, and the median and 90th percentile of arrival."""
    n = runs.agg(F.count_distinct("run_id").alias("n_runs"))
    each = runs.groupBy("row", "col").agg(F.count("toa").alias("reached")).join(exact_percentiles(runs, "toa", {"p50": 0.5, "p90": 0.9}, ("row", "col")), ["row", "col"], "left")
    return each.crossJoin(F.broadcast(n)).select("row", "col", (F.col("reached") / F.col("n_runs")).alias("burn_probability"), "p50", "p90")


def reach_summary(runs: DataFrame, res: float) -> DataFrame:
    return runs.groupBy("run_id").agg(F.count("toa").alias("cells"), (F.count("toa") * (res * res / 1e4)).alias("hectares"), F.max(F.when(F.col("toa").isNotNull(), F.col("intensity"))).alias("max_intensity"), F.max("toa").alias("max_arrival"))


def isochrone_bands(runs: DataFrame, levels: DataFrame, res: float) -> DataFrame:
    """Cells and hectares of each run by the first level that they are reached within."""
    most = runs.agg(F.max("toa").alias("most"))
    chosen = levels.crossJoin(most).where("most > above and most <= upto and level <= 1.5 * most").select("level")
    reached = runs.where("toa is not null")
    band = reached.join(F.broadcast(chosen), F.col("toa") <= F.col("level")).groupBy("run_id", "row", "col").agg(F.min("level").alias("level"))
    return band.groupBy("run_id", "level").agg(F.count(F.lit(1)).alias("cells"), (F.count(F.lit(1)) * (res * res / 1e4)).alias("hectares")).withColumn("label", F.when(F.col("level") < 1, F.concat((F.col("level") * 60).cast("int").cast("string"), F.lit(" sec"))).otherwise(F.concat(F.col("level").cast("int").cast("string"), F.lit(" min"))))


def _squares(cells: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Every four neighbouring cells (keys, row, col, toa) as one row: nw, ne, sw, se; unreached cells are 9999."""
    grid = cells.withColumn("v", F.coalesce("toa", F.lit(9999.0)))
    down, right = Window.partitionBy(*keys, "col").orderBy("row"), Window.partitionBy(*keys, "row").orderBy("col")
    step = grid.withColumn("sw", F.when(F.lead("row").over(down) == F.col("row") + 1, F.lead("v").over(down)))
    nxt = F.lead(F.struct("v", "sw", "col")).over(right)
    return step.withColumn("_n", nxt).where(F.col("_n.col") == F.col("col") + 1).select(*keys, "row", "col", F.col("v").alias("nw"), F.col("_n.v").alias("ne"), "sw", F.col("_n.sw").alias("se")).where("sw is not null and se is not null")


def _sides(level: Column) -> dict[str, Column]:
    """Where a level crosses each side of a square: x, y, and the side's number, the same from both of its squares."""
    part = lambda a, b: (level - F.col(a)) / (F.col(b) - F.col(a))
    r, c = F.col("row"), F.col("col")
    number = lambda r, c, upright: (r.cast("long") * 2**31 + c) * 2 + upright
    at = lambda y, x, n: F.struct(y.alias("y"), x.alias("x"), n.alias("node"))
    return {
        "n": at(r + 0.0, c + part("nw", "ne"), number(r, c, 0)), "s": at(r + 1.0, c + part("sw", "se"), number(r + 1, c, 0)),
        "w": at(r + part("nw", "sw"), c + 0.0, number(r, c, 1)), "e": at(r + part("ne", "se"), c + 1.0, number(r, c + 1, 1)),
    }


#: Pieces of the line through a square, from side to side, by which of its corners nw, ne, se, sw are low (8, 4, 2, 1).
#: Clockwise around the square, a piece begins where low turns high: so what ends a piece begins one in the next square.
#: The two pieces of a saddle keep its low corners apart.
PIECES = {1: ["ws"], 2: ["se"], 3: ["we"], 4: ["en"], 5: ["en", "ws"], 6: ["sn"], 7: ["wn"], 8: ["nw"], 9: ["ns"], 10: ["nw", "se"], 11: ["ne"], 12: ["ew"], 13: ["es"], 14: ["sw"]}


def _pieces(squares: DataFrame, level: Column) -> DataFrame:
    """squares with p, a piece (a, b) of the line at a level."""
    side = _sides(level)
    low = lambda c: (F.col(c) < level).cast("int")
    case = low("nw") * 8 + low("ne") * 4 + low("se") * 2 + low("sw")
    found = F.when(F.lit(False), F.array(F.struct(side["w"].alias("a"), side["s"].alias("b"))))
    for k, pieces in PIECES.items():
        found = found.when(case == k, F.array(*(F.struct(side[p[0]].alias("a"), side[p[1]].alias("b")) for p in pieces)))
    return squares.withColumn("p", F.explode(found))


def isochrone_segments(cells: DataFrame, level: float, keys: tuple[str, ...] = ()) -> DataFrame:
    """Line pieces of the contour at a level, by marching squares; unreached cells are 9999.

    A piece joins two crossings of a square's sides; the two pieces of a saddle keep its low corners apart.
    """
    out = _pieces(_squares(cells, keys), F.lit(float(level)))
    return out.select(*keys, "row", "col", F.col("p.a.x").alias("x1"), F.col("p.a.y").alias("y1"), F.col("p.b.x").alias("x2"), F.col("p.b.y").alias("y2"))


def chosen_levels(cells: DataFrame, levels: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, level): the levels (level, above, upto) that a layer's largest arrival asks for, up to 1.5 times it."""
    most = cells.groupBy(*keys).agg(F.max("toa").alias("most")) if keys else cells.agg(F.max("toa").alias("most"))
    return most.join(F.broadcast(levels), (F.col("most") > F.col("above")) & (F.col("most") <= F.col("upto")) & (F.col("level") <= 1.5 * F.col("most"))).select(*keys, "level")


def isochrone_lines(cells: DataFrame, levels: DataFrame, keys: tuple[str, ...] = (), least: int = 3) -> DataFrame:
    """(keys, level, line, closed, points): whole lines of each layer's contours, of ``least`` vertices or more.

    cells has keys, row, col and toa, levels keys and level. Crossings of the grid's sides are nodes, pieces
    links from one to the next with the low side always on one hand, and ``list_ranks`` puts each line in order.
    ``line`` is the number of its first crossing, ``points`` its (x, y) in columns and rows; a closed line ends with
    its first point. Lines end at the layer's edge and at missing cells.
    """
    squares = _squares(cells, keys)
    each = squares.join(levels, list(keys)) if keys else squares.crossJoin(levels)
    crossed = each.where((F.least("nw", "ne", "sw", "se") < F.col("level")) & (F.greatest("nw", "ne", "sw", "se") >= F.col("level")))
    own = (*keys, "level")
    pieces = stored(_pieces(crossed, F.col("level")).select(*own, "p.a", "p.b"), "pieces")
    ends = pieces.select(*own, F.col("b.node").alias("node"), F.col("b.x").alias("x"), F.col("b.y").alias("y"), F.lit(None).cast("long").alias("next"))
    both = pieces.select(*own, F.col("a.node").alias("node"), F.col("a.x").alias("x"), F.col("a.y").alias("y"), F.col("b.node").alias("next")).unionByName(ends)
    nodes = stored(both.groupBy(*own, "node").agg(F.max("next").alias("next"), F.max("x").alias("x"), F.max("y").alias("y")), "crossings")
    ranked = list_ranks(nodes.select(*own, "node", "next"), own).join(nodes.drop("next"), [*own, "node"])
    lines = ranked.groupBy(*own, F.col("chain").alias("line"), "closed").agg(F.sort_array(F.collect_list(F.struct("rank", "x", "y"))).alias("p"))
    points = F.transform("p", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))
    points = F.when(F.col("closed"), F.concat(points, F.slice(points, 1, 1))).otherwise(points)
    return lines.select(*own, "line", "closed", points.alias("points")).where(F.size("points") >= least)


def parcels_reached(places: DataFrame, limits: tuple[int, ...] = (30, 60)) -> DataFrame:
    """(within, parcel_id): a row for each of places (parcel_id, toa) and each limit of minutes that it is reached within."""
    within = F.explode(F.filter(F.array(*(F.lit(m) for m in limits)), lambda m: F.col("toa") <= m))
    return places.select(within.alias("within"), "parcel_id")


def property_exposure(places: DataFrame, cells: DataFrame) -> DataFrame:
    """places (parcel_id, row, col) with arrival p50 (the layer's median if unreached), p90 and ember exposure."""
    median = exact_percentiles(cells, "toa", {"_median": 0.5})
    whole = cells.agg(F.avg(F.when(F.col("intensity") > 0, F.col("intensity"))).alias("_mean"))
    df = places.join(cells.select("row", "col", "toa", "intensity"), ["row", "col"], "left").crossJoin(F.broadcast(whole.join(median, how="left")))  # one row
    p50 = F.coalesce("toa", "_median")
    return df.select("parcel_id", p50.alias("arrival_p50"), (p50 * 1.3).alias("arrival_p90"), F.least(F.lit(1.0), F.coalesce("intensity", "_mean", F.lit(0.0)) / 500).alias("ember_exposure"))


# --- embers -----------------------------------------------------------------------------------


def ember_launch_counts(cells: DataFrame, least_ft: float = 4.0) -> DataFrame:
    """Cells that launch embers, with n_embers, 1 to 50."""
    n = F.least(F.greatest(F.floor(5 * F.col("i_b") / 500), F.lit(1)), F.lit(50)).cast("int")
    return cells.where(F.col("flame_length") >= least_ft).withColumn("n_embers", n)


def draws(spark, n: int = 50) -> DataFrame:
    """Standard normal draws k, z_dist, z_dir of a fixed table, spread evenly: a low-discrepancy set mapped by logit."""
    u = lambda step: F.pmod((F.col("id") + 0.5) * step, F.lit(1.0))
    z = lambda x: F.ln(x / (1 - x)) / 1.702
    return spark.range(n).select((F.col("id") + 1).cast("int").alias("k"), z(u(0.754877666)).alias("z_dist"), z(u(0.569840291)).alias("z_dir"))


def ember_landing_counts(launch: DataFrame, table: DataFrame, wind_mph: float, wind_dir: float, res: float, rows: int, cols: int, as_coded: bool = False) -> DataFrame:
    """(row, col, embers): where the embers of launching cells come down."""
    each = launch.select("row", "col", F.explode(F.sequence(F.lit(1), F.col("n_embers"))).alias("k")).join(F.broadcast(table), "k")
    dist = F.exp(5.5 + 1.2 * F.col("z_dist")) * (1 + 0.5 * (wind_mph * 0.44704) / 10)
    heading = F.radians(F.lit(wind_dir + (0 if as_coded else 180)) + 20 * F.col("z_dir"))
    row = F.col("row") - F.floor(dist * F.cos(heading) / res + 0.5)
    col = F.col("col") + F.floor(dist * F.sin(heading) / res + 0.5)
    landed = each.select(row.cast("int").alias("row"), col.cast("int").alias("col")).where(F.col("row").between(0, rows - 1) & F.col("col").between(0, cols - 1))
    return landed.groupBy("row", "col").agg(F.count(F.lit(1)).alias("embers"))


def ignition_probability(cells: DataFrame, receptivity: DataFrame, moisture: float) -> DataFrame:
    """cells (embers, fbfm40) with p_ignition."""
    p = F.least(F.greatest(0.9 * F.exp(F.lit(-4.3 * moisture)), F.lit(0.0)), F.lit(1.0))
    out = cells.join(F.broadcast(receptivity.withColumnRenamed("code", "fbfm40")), "fbfm40", "left")
    return out.withColumn("p_ignition", 1 - F.exp(-F.coalesce("embers", F.lit(0)) * p * F.coalesce("receptivity", F.lit(0.7)))).drop("receptivity")


def spotting_distance(wind_mph: Column, flame_ft: Column) -> dict[str, Column]:
    """Greatest, probable and 90th percentile distance of spot fires, in metres."""
    u, f = wind_mph * 0.44704, flame_ft * 0.3048
    scale = u / 10 * (f / 5)
    return {"max_m": F.least(0.162 * F.pow(u, F.lit(2.2)) * F.pow(f, F.lit(0.6)), F.lit(5000.0)), "probable_m": F.exp(F.lit(5.5)) * scale, "p90_m": F.exp(F.lit(5.5 + 1.28 * 1.2)) * scale}
