"""What-if: actions applied to properties, ranked and in sequence."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from perilframe import dims
from perilframe.operators.scoring import mapping, rule_score

#: Takes what an action changes, as columns, and gives the score.
Scorer = Callable[..., Column]


def _roof(material: Column) -> Column:
    return F.coalesce(mapping(dims.ROOF_CLASS)[material].cast("double"), F.lit(2.0))


def changed_score(set_roof: Column, set_vent: Column, set_z1: Column, z2_mult: Column, clears_ladder: Column, scorer: Scorer = rule_score) -> Column:
    return scorer(
        roof=F.when(set_roof.isNotNull(), _roof(set_roof)).otherwise(F.col("roof_material_encoded")),
        vent=F.when(set_vent.isNotNull(), (set_vent == "screened").cast("double")).otherwise(F.col("vent_screened")),
        z1=F.coalesce(set_z1, F.col("zone1_fuel_load")),
        z2=F.col("zone2_fuel_load") * z2_mult,
        ladder=F.when(clears_ladder, F.lit(0.0)).otherwise(F.col("ladder_fuel_present")),
    )


def apply_action(encoded: DataFrame, actions: DataFrame) -> DataFrame:
    """Each property with each action's fields: the roof, vents, fuel loads, continuity and ladder flag after it."""
    both = encoded.crossJoin(F.broadcast(actions))  # a fixed handful of actions
    return both.withColumns({
        "new_z1": F.coalesce("set_z1", "zone1_fuel_load"), "new_z2": F.col("zone2_fuel_load") * F.col("z2_mult"),
        "new_z3_continuity": F.least("zone3_fuel_continuity", F.coalesce("cap_z3c", F.lit(1e9))), "new_ladder": F.when(F.col("clears_ladder"), F.lit(0.0)).otherwise(F.col("ladder_fuel_present")),
    })


def with_metrics(df: DataFrame, before: str = "before", after: str = "after") -> DataFrame:
    """Points and per cent, minutes gained, survival, and cost a point ('N/A' if nothing is gained)."""
    d = F.col(before) - F.col(after)
    cost = lambda c: F.when(d <= 0, "N/A").otherwise(F.concat(F.lit("$"), F.format_number(F.rint(F.col(c) / d), 0)))
    return df.withColumns({
        "points": d, "pct": 100 * d / F.greatest(F.col(before), F.lit(0.01)), "minutes_gained": d * 0.3, "survival_gain": F.least(d / 30, F.lit(0.5)),
        "cost_per_point_low": cost("cost_low"), "cost_per_point_high": cost("cost_high"),
    })


def rank_mitigations(encoded: DataFrame, actions: DataFrame, by: str = "points", scorer: Scorer = rule_score) -> DataFrame:
    """Every action alone, those that help, ranked by points (or by least cost a point: ``by='cost'``)."""
    both = encoded.crossJoin(F.broadcast(actions))
    scored = both.withColumn("before", scorer()).withColumn("after", changed_score(F.col("set_roof"), F.col("set_vent"), F.col("set_z1"), F.col("z2_mult"), F.col("clears_ladder"), scorer))
    helps = with_metrics(scored).where("points > 0")
    first = F.desc(F.round("points", 9)) if by == "points" else F.asc(F.round(F.col("cost_low") / F.col("points"), 6))
    order = Window.partitionBy("parcel_id").orderBy(first, "action")
    return helps.withColumn("priority_rank", F.row_number().over(order))


def counterfactual_sequence(encoded: DataFrame, actions: DataFrame, keys: Column, scorer: Scorer = rule_score) -> DataFrame:
    """Actions one after the other: a row for each step, with the score before and after it.

    ``keys`` is an array of action keys; unknown ones are skipped. Later settings override earlier ones,
    reductions multiply, the continuity cap is the least so far.
    """
    steps = encoded.withColumn("keys", keys).select("*", F.posexplode("keys").alias("at", "action")).join(F.broadcast(actions), "action")
    own = Window.partitionBy("parcel_id").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    state = steps.withColumns({
        "step": F.count(F.lit(1)).over(own).cast("int"),
        "c_roof": F.last("set_roof", True).over(own), "c_vent": F.last("set_vent", True).over(own), "c_z1": F.last("set_z1", True).over(own),
        "c_z2": F.aggregate(F.collect_list("z2_mult").over(own), F.lit(1.0), lambda a, x: a * x), "c_cap": F.min("cap_z3c").over(own), "c_ladder": F.max("clears_ladder").over(own),
    })
    scored = state.withColumn("after", changed_score(F.col("c_roof"), F.col("c_vent"), F.col("c_z1"), F.col("c_z2"), F.col("c_ladder"), scorer)).withColumn("original", scorer())
    previous = F.lag("after").over(Window.partitionBy("parcel_id").orderBy("at"))
    return scored.withColumn("before", F.coalesce(previous, F.col("original")))


def mitigation_total(sequence: DataFrame) -> DataFrame:
    """The original and final score of each property, and the reduction in per cent (0 of nothing)."""
    end = sequence.groupBy("parcel_id").agg(F.max_by("after", "step").alias("mitigated"), F.max("original").alias("original"))
    return end.withColumn("total_pct", F.when(F.col("original") <= 0, 0.0).otherwise((F.col("original") - F.col("mitigated")) / F.col("original") * 100))


def before_after_rows(ranked: DataFrame, n: int = 8) -> DataFrame:
    """The first rows of the comparison view."""
    return ranked.where(F.col("priority_rank") <= n).select("parcel_id", "priority_rank", "action", "before", "after", (F.col("before") - F.col("after")).alias("difference"))
