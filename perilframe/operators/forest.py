"""Least barriers in a graph, by Borůvka's forest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perilframe.operators.iterate import discard, stored


def _roots(links: DataFrame) -> DataFrame:
    """(comp, ptr, moved) with ptr moved on to the end of its chain, where a comp names itself; a ptr without a row is an end, too."""
    now = stored(links, "pointers")
    while True:
        onward = now.select(F.col("comp").alias("ptr"), F.col("ptr").alias("_next"))
        new = now.join(onward, "ptr", "left").select("comp", F.coalesce("_next", "ptr").alias("ptr"), (F.coalesce("_next", "ptr") != F.col("ptr")).alias("moved"))
        new = stored(new, "pointers")
        discard(now)
        done, now = new.where("moved").isEmpty(), new
        if done:
            return now


def least_barriers(edges: DataFrame, root: int = -1) -> tuple[DataFrame, int]:
    """(node, level) of edges (a, b, w): the least w over all paths to the root of a path's largest weight; and the number of rounds.

    Each round, every component but the root's joins the one across its lightest edge (of ties by its ends' least
    and greatest component). Whoever leaves a component climbs that edge at least, and climbing it is enough, so
    a node's level is the largest edge that its components have left by. Components are at most half as many after each
    round. Nodes that no path joins to the root are left out. Shuffles are by component.
    """
    both = lambda e: e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"), "w"))
    least = lambda e: e.where("a <> b").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.min("w").alias("w"))
    live = stored(least(edges), "barriers")
    nodes = stored(both(live).where(F.col("a") != root).select(F.col("a").alias("node"), F.col("a").alias("comp"), F.lit(float("-inf")).alias("level")).distinct(), "nodes")
    rounds = 0
    while not live.isEmpty():
        rounds += 1
        lightest = F.min(F.struct("w", F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"), F.col("b").alias("to")))
        chosen = stored(both(live).where(F.col("a") != root).groupBy(F.col("a").alias("comp")).agg(lightest.alias("e")).select("comp", "e.to", "e.w"), "chosen")
        back = chosen.select(F.col("comp").alias("to"), F.col("to").alias("_back"))
        stays = F.coalesce((F.col("_back") == F.col("comp")) & (F.col("comp") < F.col("to")), F.lit(False))  # of two that choose each other
        linked = chosen.join(back, "to", "left").select("comp", F.when(stays, F.col("comp")).otherwise(F.col("to")).alias("ptr"))
        ends = _roots(linked)
        moved = stored(ends.join(chosen, "comp").select("comp", "ptr", F.when(F.col("ptr") != F.col("comp"), F.col("w")).alias("w")), "moved")
        discard(ends, chosen)
        new_nodes = stored(nodes.join(moved, "comp", "left").select("node", F.coalesce("ptr", "comp").alias("comp"), F.greatest("level", "w").alias("level")), "nodes")
        to = moved.select("comp", "ptr")
        step = live.join(to.withColumnsRenamed({"comp": "a", "ptr": "_a"}), "a", "left").join(to.withColumnsRenamed({"comp": "b", "ptr": "_b"}), "b", "left")
        new_live = stored(least(step.select(F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b"), "w")), "barriers")
        discard(nodes, live, moved)
        nodes, live = new_nodes, new_live
    return nodes.where(F.col("comp") == root).select("node", "level"), rounds
