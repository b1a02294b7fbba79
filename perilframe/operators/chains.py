"""Chains of linked rows, put in order by pointer doubling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perilframe.operators.iterate import discard, stored


def list_ranks(links: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, node, chain, rank, closed) of links (keys, node, next), in which a node has one row and is the next of one at most.

    ``next`` is null at a chain's end. ``chain`` is the chain's first node and ``rank`` a node's number of
    steps from it; a closed chain begins at its least node. Each round, every open pointer takes over what the
    node it names has seen, so that rounds are the logarithm of the longest chain. Where a round ends no
    chain and finds no lesser node, only closed chains are left, each of whose nodes knows the least one: they
    are cut there and ranked as open ones. Shuffles are by node, however long a chain is.
    """
    open_, rest = _ended(links, keys)
    out = _ranked(open_, keys).withColumn("closed", F.lit(False))
    if not rest.isEmpty():
        cut = rest.select(*keys, "node", F.when(F.col("next") != F.col("least"), F.col("next")).alias("next"))
        out = out.unionByName(_ranked(_ended(cut, keys)[0], keys).withColumn("closed", F.lit(True)))
    return out


def _ended(links: DataFrame, keys: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """(keys, node, ptr, hops) of chains that end, with ptr the end; and (keys, node, next, least) of those that don't."""
    last = F.col("next").isNull()
    state = stored(links.select(*keys, "node", "next", F.coalesce("next", "node").alias("ptr"), F.when(last, 0).otherwise(1).cast("long").alias("hops"), F.col("node").alias("least"), last.alias("ended"), F.lit(False).alias("moved")), "links")
    while not state.where("not ended").isEmpty():
        seen = state.select(*keys, F.col("node").alias("ptr"), F.col("ptr").alias("_ptr"), F.col("hops").alias("_hops"), F.col("least").alias("_least"), F.col("ended").alias("_ended"))
        far = state.where("not ended").join(seen, [*keys, "ptr"])
        moved = F.col("_ended") | (F.col("_least") < F.col("least"))
        far = far.select(*keys, "node", "next", F.col("_ptr").alias("ptr"), (F.col("hops") + F.col("_hops")).alias("hops"), F.least("least", "_least").alias("least"), F.col("_ended").alias("ended"), moved.alias("moved"))
        new = stored(state.where("ended").withColumn("moved", F.lit(False)).unionByName(far), "links")
        discard(state)
        state = new
        if state.where("moved").isEmpty():
            break
    return state.where("ended").select(*keys, "node", "ptr", "hops"), state.where("not ended").select(*keys, "node", "next", "least")


def _ranked(ended: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    first = ended.groupBy(*keys, "ptr").agg(F.max(F.struct("hops", "node")).alias("first"))
    return ended.join(first, [*keys, "ptr"]).select(*keys, "node", F.col("first.node").alias("chain"), (F.col("first.hops") - F.col("hops")).alias("rank"))
