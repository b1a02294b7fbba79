"""Running totals over a whole table, in levels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a range, at most, if orders are dense; and ranges that are put in order in one row.
SPAN = 1024


def totals_before(df: DataFrame, order: str, value: str, out: str, span: int = SPAN) -> DataFrame:
    """df (order, a long that no two rows share, and value) with ``out``: the sum of value over all rows of smaller order, 0 for the first.

    Rows are dealt to ranges of ``span`` orders; a window adds up inside a range, and the ranges' totals are added up the
    same way, one level up, until all lie in one range: its rows, ``span`` at most, are one array. Shuffles are by range.
    """
    at = f"_{order}_range"
    dealt = df.withColumn(at, F.expr(f"({order} - pmod({order}, {span})) div {span}"))
    earlier = Window.partitionBy(at).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.sum(value).over(earlier), F.lit(0))
    ends = dealt.agg(F.min(at).alias("a"), F.max(at).alias("z")).first()
    totals = dealt.groupBy(at).agg(F.sum(value).alias("_total"))
    if ends["a"] is None or ends["z"] - ends["a"] < span:
        row = totals.agg(F.collect_list(F.struct(F.col(at).alias("at"), F.col("_total").alias("n"))).alias("_all"))
        kind = totals.schema["_total"].dataType
        before = F.aggregate(F.filter("_all", lambda x: x["at"] < F.col(at)), F.lit(0).cast(kind), lambda s, x: (s + x["n"]).cast(kind))
        return dealt.withColumn("_inside", inside).crossJoin(F.broadcast(row)).withColumn(out, F.col("_inside") + before).drop(at, "_inside", "_all")
    offset = f"{at}_offset"
    above = totals_before(totals, at, "_total", offset, span).select(at, offset)
    return dealt.withColumn("_inside", inside).join(above, at).withColumn(out, F.col("_inside") + F.col(offset)).drop(at, "_inside", offset)
