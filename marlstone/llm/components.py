"""Connected components of an undirected graph by alternating star contraction.

Every round is a handful of joins and aggregates over the edge list; nothing is gathered
on the driver but a count and a checksum. Lineage is cut each round with a written table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.session import scratch, written


def _minimum(edges: DataFrame) -> DataFrame:
    """Smallest neighbour of each ``hi``; written, so that the join below can split a hot node."""
    return written(edges.groupBy("hi").agg(F.min("lo").alias("least")), "star-min")


def _large_star(edges: DataFrame) -> DataFrame:
    pairs = F.array(F.struct("hi", "lo"), F.struct(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
    both = written(edges.select(F.explode(pairs).alias("p")).select("p.hi", "p.lo"), "star-both")
    least = _minimum(both).select("hi", F.least("hi", "least").alias("least"))
    joined = both.join(least, "hi").where("lo > hi")
    return joined.select(F.col("lo").alias("hi"), F.col("least").alias("lo")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    joined = edges.join(_minimum(edges), "hi")
    turned = F.array(F.struct(F.col("lo").alias("hi"), F.col("least").alias("lo")), F.struct(F.col("hi"), F.col("least").alias("lo")))
    return joined.select(F.explode(turned).alias("p")).select("p.hi", "p.lo").where("hi <> lo").distinct()


def _state(edges: DataFrame) -> tuple:
    mixed = F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))
    return tuple(edges.agg(F.count("*"), mixed).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of ``edges`` (columns a, b); root is the component's smallest node.

    Loops, repeated and null edges are ignored; no edges give no rows. A round's tables are removed
    when the next has been written.
    """
    spark = edges.sparkSession
    oriented = edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo"))
    with scratch(spark) as own:
        now = written(oriented.distinct(), "star")
        state = _state(now)
        while state[0]:
            with scratch(spark) as turn:
                now = turn.keep(written(_small_star(written(_large_star(now), "star")), "star"))
            before, state = state, _state(now)
            if state == before:
                break
        own.keep(now)
    roots = now.select("lo").distinct()
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("root")).unionByName(roots.select(F.col("lo").alias("node"), F.col("lo").alias("root")))
