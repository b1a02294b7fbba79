"""Exact quantiles of groups of any size, by selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from perilframe.operators.iterate import discard, stored

#: Distinct values that are sorted in one row, and bins of a round.
PICK, BINS = 1024, 64


def _at(values: Column, before: Column, rank: Column) -> Column:
    """The value at a rank of (v, c) pairs in order, with ``before`` rows below them."""
    step = lambda s, e: F.struct((s["n"] + e["c"]).alias("n"), F.when(s["v"].isNull() & (rank < s["n"] + e["c"]), e["v"]).otherwise(s["v"]).alias("v"))
    return F.aggregate(values, F.struct(before.alias("n"), F.lit(None).cast("double").alias("v")), step, lambda s: s["v"])


def exact_percentiles(df: DataFrame, value: str, probs: dict[str, float], keys: tuple[str, ...] = (), pick: int = PICK) -> DataFrame:
    """(keys, name of each prob): quantiles between the two nearest values by rank, equal to the last bit to ``percentile``; groups without values have no row, and a whole table without any has one of nulls.

    Equal values are counted first, so that no number of repeats matters. While a quantile's bracket holds more than
    ``pick`` distinct values, it is cut into BINS of about equally many; their exact counts tell which of them hold the
    two ranks, and these are the next bracket. What is left is sorted in one row. So rounds go with the logarithm of a
    group's distinct values, and each counts in all tasks, however the rows are dealt to groups.
    """
    v = F.col(value).cast("double")
    base = stored(df.where(F.col(value).isNotNull()).groupBy(*keys, v.alias("v")).agg(F.count(F.lit(1)).alias("c")), "values")
    sizes = base.groupBy(*keys).agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("m"), F.min("v").alias("x"), F.max("v").alias("y")).where("m > 0")
    wanted = F.explode(F.array(*(F.struct(F.lit(k).alias("name"), F.lit(float(p)).alias("p")) for k, p in probs.items())))
    at = (F.col("n") - 1) * F.col("q.p")
    own = (*keys, "name")
    state = sizes.withColumn("q", wanted).select(*keys, "q.name", at.alias("at"), F.floor(at).alias("lo"), F.ceil(at).alias("hi"), F.lit(0).cast("long").alias("below"), "m", "x", "y")
    state = stored(state, "brackets")
    met = lambda some: (base.join(some, list(keys)) if keys else base.crossJoin(F.broadcast(some))).where("v between x and y")  # noqa: E731  without keys a row for each prob
    while not state.where(F.col("m") > pick).isEmpty():
        open_ = state.where(F.col("m") > pick)
        within = met(open_)
        cuts = within.groupBy(*own).agg(F.percentile_approx("v", [k / BINS for k in range(1, BINS)], F.lit(100 * BINS)).alias("cuts"))
        binned = within.join(cuts, list(own)).withColumn("bin", F.size(F.filter("cuts", lambda c: c < F.col("v"))))
        bins = binned.groupBy(*own, "bin").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("bin_m"), F.min("v").alias("bin_x"), F.max("v").alias("bin_y"))
        order = Window.partitionBy(*own).orderBy("bin")  # BINS rows
        found = bins.join(open_.select(*own, "at", "lo", "hi", "below"), list(own)).withColumn("end", F.col("below") + F.sum("n").over(order)).withColumn("begin", F.col("end") - F.col("n"))
        held = found.where("end > lo and begin <= hi")
        new = held.groupBy(*own, "at", "lo", "hi").agg(F.min("begin").alias("below"), F.sum("bin_m").alias("m"), F.min("bin_x").alias("x"), F.max("bin_y").alias("y"))
        after = stored(state.where(F.col("m") <= pick).unionByName(new), "brackets")
        discard(state)
        state = after
    picked = met(state).groupBy(*own, "at", "lo", "hi", "below").agg(F.sort_array(F.collect_list(F.struct("v", "c"))).alias("values"))
    ends = picked.select(*own, "at", "lo", "hi", _at(F.col("values"), F.col("below"), F.col("lo")).alias("a"), _at(F.col("values"), F.col("below"), F.col("hi")).alias("b"))
    between = F.when((F.col("lo") == F.col("hi")) | (F.col("a") == F.col("b")), F.col("a")).otherwise((F.col("hi") - F.col("at")) * F.col("a") + (F.col("at") - F.col("lo")) * F.col("b"))
    return ends.groupBy(*keys).agg(*(F.max(F.when(F.col("name") == k, between)).alias(k) for k in probs))
