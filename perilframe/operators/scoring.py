"""Property risk: encoding, rule score, categories, losses, and a trained model."""

from __future__ import annotations

import math

from functools import reduce

from itertools import chain

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from perilframe import dims
from perilframe.operators.prefix import totals_before

MODEL_FEATURES = [f[0] for f in dims.FEATURES]
_DEFAULT = {f[0]: f[1] for f in dims.FEATURES}


def mapping(values: dict) -> Column:
    return F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in values.items()))


def _or_default(df: DataFrame, name: str, fill_zero: bool) -> Column:
    default = F.lit(0.0 if fill_zero else _DEFAULT[name])
    return F.coalesce(F.col(name).cast("double"), default) if name in df.columns else default


def encode_features(df: DataFrame, fill_zero: bool = False) -> DataFrame:
    """df with the 19 model features as doubles. Absent columns and nulls take defaults (zero, if ``fill_zero``)."""
    out = {
        "tpi_class_encoded": F.coalesce(mapping(dims.TPI_CLASS)[F.col("tpi_class")].cast("double"), F.lit(1.0)) if "tpi_class" in df.columns else F.lit(1.0),
        "roof_material_encoded": F.coalesce(mapping(dims.ROOF_CLASS)[F.col("roof_material")].cast("double"), F.lit(2.0)) if "roof_material" in df.columns else F.lit(2.0),
        "vent_screened": F.when(F.col("vent_screening_status") == "screened", 1.0).otherwise(0.0) if "vent_screening_status" in df.columns else F.lit(0.0),
    }
    out |= {n: _or_default(df, n, fill_zero) for n in MODEL_FEATURES if n not in out}
    return df.withColumns({n: out[n] for n in MODEL_FEATURES})


def feature_vector(names: list[str] = MODEL_FEATURES) -> Column:
    return F.array(*(F.col(n) for n in names))


def components(z1=None, z2=None, ladder=None, roof=None, vent=None) -> dict[str, Column]:
    """Terrain, vegetation, structure and exposure points over encoded features; arguments stand in for columns."""
    col = F.col
    z1, z2 = col("zone1_fuel_load") if z1 is None else z1, col("zone2_fuel_load") if z2 is None else z2
    ladder, roof = col("ladder_fuel_present") if ladder is None else ladder, col("roof_material_encoded") if roof is None else roof
    vent, near = col("vent_screened") if vent is None else vent, col("neighbor_distance_m")
    roof_points = F.coalesce(mapping(dims.ROOF_POINTS)[roof.cast("int")], F.lit(10.0))
    return {
        "terrain": F.least(col("slope_degrees") * 0.5, F.lit(15.0)) + col("heat_load_index") * 5 + col("tpi_class_encoded") * 2,
        "vegetation": F.least(z1 * 20, F.lit(12.0)) + F.least(z2 * 5, F.lit(10.0)) + F.least(col("zone3_fuel_load") * 2, F.lit(5.0)) + ladder * 8,
        "structure": roof_points + (1 - vent) * 12,
        "exposure": F.when(near < 20, F.greatest(F.lit(0.0), 10 - near * 0.5)).otherwise(0.0) + col("ember_exposure_probability") * 5,
    }


def clip(x: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(x, F.lit(float(lo))), F.lit(float(hi)))


def rule_score(**changed: Column) -> Column:
    c = components(**changed)
    return clip(c["terrain"] + c["vegetation"] + c["structure"] + c["exposure"], 0, 100)


def wildfire_score(df: DataFrame, fill_zero: bool = False) -> DataFrame:
    """df, encoded, with wildfire_risk_score."""
    return encode_features(df, fill_zero).withColumn("wildfire_risk_score", rule_score())


def score_components(encoded: DataFrame) -> DataFrame:
    return encoded.withColumns({f"{k}_points": v for k, v in components().items()})


def risk_category(score: Column) -> Column:
    return F.when(score < 30, "LOW").when(score < 55, "MODERATE").when(score < 75, "HIGH").otherwise("VERY HIGH")


def flood_score(df: DataFrame) -> Column:
    get = lambda n, d: F.coalesce(F.col(n).cast("double"), F.lit(d)) if n in df.columns else F.lit(d)
    hundred = F.coalesce(F.col("in_fema_100yr").cast("int"), F.lit(0)) if "in_fema_100yr" in df.columns else F.lit(0)
    low = F.greatest(F.lit(0.0), (10 - get("hand_m", 20.0)) * 5) + F.greatest(F.lit(0.0), (1000 - get("distance_to_stream_m", 500.0)) * 0.05)
    return clip(low + F.least(get("cti", 5.0) * 2, F.lit(20.0)) + 30 * hundred, 0, 100)


def composite_score(wildfire: Column, flood: Column, penalty: Column | float = 0.0, wildfire_only: bool = False) -> Column:
    return wildfire if wildfire_only else clip(0.65 * wildfire + 0.35 * flood + penalty, 0, 100)


def annual_loss(df: DataFrame, segments: DataFrame, score: str = "wildfire_risk_score", use: str = "use_type", value: str = "assessed_value") -> DataFrame:
    """df with loss_pct and loss_usd, linear between the knots of the use type's curve (residential if unknown)."""
    known = sorted(dims.LOSS_CURVES)
    s = clip(F.col(score), 0, 100)
    curve = F.when(F.col(use).isin(known), F.col(use)).otherwise("residential")
    lo = F.least(F.floor(s / 25) * 25, F.lit(75)).cast("double")
    seg = segments.select(F.col("use_type").alias("_use"), F.col("lo").alias("_lo"), "hi", "y0", "y1")
    out = df.withColumn("_use", curve).withColumn("_lo", lo).join(F.broadcast(seg), ["_use", "_lo"], "left")
    pct = F.col("y0") + (F.col("y1") - F.col("y0")) * (s - F.col("_lo")) / (F.col("hi") - F.col("_lo"))
    return out.withColumn("loss_pct", pct).withColumn("loss_usd", pct * F.col(value)).drop("_use", "_lo", "hi", "y0", "y1")


def risk_percentile(df: DataFrame, score: str = "wildfire_risk_score", step: float = 0.01) -> DataFrame:
    """df with risk_percentile: 100 * percent_rank over all rows.

    Equal scores are counted first. Running sums go over score steps, which a bounded number of steps
    covers, and inside a step over its distinct scores; no row is ranked by itself.
    """
    equal = df.where(F.col(score).isNotNull()).groupBy(F.col(score).alias("_s")).agg(F.count(F.lit(1)).alias("_m")).withColumn("_cell", F.floor(F.col("_s") / step))
    counts = equal.groupBy("_cell").agg(F.sum("_m").alias("_n"))
    before = totals_before(counts, "_cell", "_n", "_before").select("_cell", "_before").crossJoin(F.broadcast(counts.agg(F.sum("_n").alias("_all"))))  # one row
    inside = F.sum("_m").over(Window.partitionBy("_cell").orderBy("_s")) - F.col("_m")
    ranks = equal.withColumn("_r", inside).join(before, "_cell").select("_s", "_r", "_before", "_all")
    out = df.join(ranks, F.col(score) == F.col("_s"), "left").drop("_s")
    pct = F.when(F.col("_all") > 1, 100.0 * (F.col("_before") + F.col("_r")) / (F.col("_all") - 1)).otherwise(0.0)
    return out.withColumn("risk_percentile", F.when(F.col(score).isNotNull(), pct)).drop("_before", "_all", "_r")


# --- trained model -----------------------------------------------------------------------

#: Rows of a partition of training data, about 440 bytes each in the cache.
TRAINING_ROWS = 100_000


def dealt(df: DataFrame, label: str) -> DataFrame:
    """Features and label in partitions of about ``TRAINING_ROWS``, however few ones df has: training caches its rows, and a task reads a whole partition of them in each round."""
    rows = df.select(*MODEL_FEATURES, label)
    return rows.repartition(max(1, math.ceil(rows.count() / TRAINING_ROWS)))


def train_risk_model(df: DataFrame, label: str, trees: int = 20, depth: int = 4, step: float = 0.1, subsample: float = 0.8, seed: int = 7):
    """A gradient-boosted regression on the 19 features, as a pipeline model."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    assembler = VectorAssembler(inputCols=MODEL_FEATURES, outputCol="features", handleInvalid="keep")
    trees_ = GBTRegressor(featuresCol="features", labelCol=label, maxIter=trees, maxDepth=depth, stepSize=step, subsamplingRate=subsample, seed=seed)
    return Pipeline(stages=[assembler, trees_]).fit(dealt(df, label).fillna(0.0, MODEL_FEATURES))


def model_score(model, df: DataFrame) -> DataFrame:
    """df with model_score: 100 times the prediction, from 0 to 100; null features are zero."""
    return model.transform(df.fillna(0.0, MODEL_FEATURES)).withColumn("model_score", clip(F.col("prediction") * 100, 0, 100)).drop("features", "prediction")


NODES = "tree int, weight double, node int, feature string, threshold double, left int, right int, value double"


def model_nodes(model, spark) -> DataFrame:
    """A trained model's trees as a table: a row for each node; leaves have a value, other nodes a feature, a threshold and the nodes to go on to, left up to the threshold."""
    ensemble, rows = model.stages[-1], []
    for t, (tree, weight) in enumerate(zip(ensemble.trees, ensemble.treeWeights)):
        open_ = [tree._java_obj.rootNode()]
        for k, node in enumerate(open_):  # grows as it goes
            if node.subtreeDepth() == 0:
                rows.append((t, weight, k, None, None, None, None, node.prediction()))
            else:
                left = len(open_)
                open_ += [node.leftChild(), node.rightChild()]
                rows.append((t, weight, k, MODEL_FEATURES[node.split().featureIndex()], node.split().threshold(), left, left + 1, None))
    return spark.createDataFrame(rows, NODES)


def _trees(nodes: DataFrame, leaf, branch) -> list:
    """Each tree of a table of nodes, folded from its leaves; its size is the model's, not the data's."""
    table: dict[int, dict[int, Row]] = {}
    for r in nodes.collect():
        table.setdefault(r["tree"], {})[r["node"]] = r
    fold = lambda own, k: leaf(own[k]) if own[k]["feature"] is None else branch(own[k], fold(own, own[k]["left"]), fold(own, own[k]["right"]))
    return [fold(table[t], 0) for t in sorted(table)]


def tree_score(nodes: DataFrame) -> Column:
    """Score, 0 to 100, of a table of nodes as one expression over the features; null features are zero."""
    parts = _trees(nodes, lambda n: F.lit(n["weight"] * n["value"]), lambda n, a, b: F.when(F.coalesce(F.col(n["feature"]).cast("double"), F.lit(0.0)) <= n["threshold"], a).otherwise(b))
    return clip(reduce(lambda x, y: x + y, parts) * 100, 0, 100)


def tree_sql(nodes: DataFrame) -> str:
    """The same as SQL."""
    parts = _trees(nodes, lambda n: f"CAST({n['weight'] * n['value']!r} AS DOUBLE)", lambda n, a, b: f"CASE WHEN coalesce(CAST({n['feature']} AS DOUBLE), 0) <= CAST({n['threshold']!r} AS DOUBLE) THEN {a} ELSE {b} END")
    return f"least(greatest(100 * ({' + '.join(parts)}), 0), 100)"


def model_metrics(model, df: DataFrame, label: str) -> DataFrame:
    p = model.transform(df.fillna(0.0, MODEL_FEATURES)).withColumn("e", F.col("prediction") - F.col(label))
    sums = p.agg(F.sqrt(F.avg(F.col("e") * F.col("e"))).alias("rmse"), F.avg(F.abs("e")).alias("mae"), (1 - F.sum(F.col("e") * F.col("e")) / (F.var_pop(label) * F.count(label))).alias("r2"))
    return sums


def feature_importance(model, spark) -> DataFrame:
    rows = [(n, float(x)) for n, x in zip(MODEL_FEATURES, model.stages[-1].featureImportances.toArray())]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature")


def save_model(model, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str):
    from pyspark.ml import PipelineModel

    return PipelineModel.load(path)
