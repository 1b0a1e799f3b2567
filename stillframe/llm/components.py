"""Connected components by alternating large-star and small-star over an edge table.

Each round is two joins on the node with a pre-aggregated minimum, so that a node with very many neighbours is split
like any skewed join key; its result is written to the shared scratch folder, which cuts lineage. Rounds grow with the
logarithm of the number of nodes. Nothing but two numbers per round reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._util import Scratch


def _large_star(e: DataFrame) -> DataFrame:
    both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b")


def _small_star(e: DataFrame) -> DataFrame:
    least = e.groupBy("a").agg(F.min("b").alias("m"))
    rest = e.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return rest.unionByName(least.select("a", F.col("m").alias("b")))


def connected_components(edges: DataFrame, scratch: Scratch, max_rounds: int = 60) -> DataFrame:
    """node, component (the smallest node reachable) for every node of edges (a, b); loops and nulls are ignored."""
    oriented = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    e = scratch.save(oriented.distinct(), "edges")
    digest = None
    for _ in range(max_rounds):
        nxt = scratch.save(_small_star(_large_star(e).distinct()).distinct(), "star")
        r = nxt.agg(F.count("*").alias("n"), F.sum((F.xxhash64("a", "b") % (1 << 40))).alias("h")).first()
        scratch.drop(e)
        e = nxt
        if (r["n"], r["h"]) == digest:
            break
        digest = (r["n"], r["h"])
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


#: Numbers up to this one stand for rows without an id.
MADE = -(1 << 62)


def named(component: DataFrame) -> DataFrame:
    """Components under their smallest real id rather than a made number, where they have one."""
    name = component.where(F.col("node") > MADE).groupBy("component").agg(F.min("node").alias("name"))
    return component.join(name, "component", "left").select("node", F.coalesce("name", "component").alias("component"))
