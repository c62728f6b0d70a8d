"""Connected components of an edge table, by alternating large-star and small-star steps.

After Kiveris et al., "Connected Components in MapReduce and Beyond" (2014). Each step is an
aggregation with partial sums and an equi-join, so that a hub with a third of all edges is
pre-aggregated, and AQE splits its side of the join. Each round is written to the shared folder,
which cuts the lineage; nothing but a count and a checksum reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from telemaris.llm.common import written


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, label) for every node of edges (a, b): label is the least node of its component.

    Null ends and loops are no edges. Nodes of any orderable type. An empty table gives an empty table.
    """
    now = edges.select("a", "b").where("a != b")
    now = now.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now, before = written(now, "edges"), None
    for _ in range(most_rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        rest = large.join(least, "a").where("b != m").select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b"))
        now = written(least.select("a", F.col("m").alias("b")).unionByName(rest).distinct(), "edges")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
