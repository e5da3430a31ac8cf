"""Connected components of an undirected graph by alternating large and small stars, on DataFrames alone.

Each round is two joins and ends in reliable files; the number of rounds grows with the logarithm of the graph.
Hub nodes are no single task: minima are partial aggregates and the joins are ones that Spark may split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Tables, cut


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(links: DataFrame) -> DataFrame:
    """links: columns a, b (longs). Returns node, root for every node with a link to another; root is the least node reachable."""
    tables, n = Tables(links.sparkSession, "components"), 0
    try:
        edges = tables.save(links.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "0")
        state = _state(edges)
        while state[0]:
            both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
            least = both.groupBy("u").agg(F.min("v").alias("lo")).select("u", F.least("u", "lo").alias("lo"))
            large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("lo").alias("v")).distinct()
            large = tables.save(large, f"{n}-large")
            lowest = large.groupBy("u").agg(F.min("v").alias("lo"))
            small = large.join(lowest, "u").where("v != lo").select(F.col("v").alias("u"), F.col("lo").alias("v"))
            edges = tables.save(small.unionByName(lowest.select("u", F.col("lo").alias("v"))).distinct(), f"{n + 1}")
            tables.drop(f"{n}")
            tables.drop(f"{n}-large")
            n += 1
            before, state = state, _state(edges)
            if before == state:
                break
        every = edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        return cut(every.repartition("node"))  # evenly, whatever the rounds left
    finally:
        tables.drop()
