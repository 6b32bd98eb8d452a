"""Connected components of a link table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairlead.llm.common import stable


def connected_components(links: DataFrame, most_rounds: int = 100) -> DataFrame:
    """``links(a long, b long)`` -> ``(node, root)`` with the least reachable node, for nodes that have a link.

    Each round hooks every node's greater neighbours to its least neighbour, then every node's lesser ones
    (large star, small star); about log(n) rounds suffice. A round is two joins and sums over (node, node) rows;
    the centre of a star is a hot key, and both joins leave its partition to be split by adaptive execution.
    Every round is checkpointed. Null ends and self links are ignored, repeated links count once.
    """
    lo, hi = F.least("a", "b"), F.greatest("a", "b")
    edges = stable(links.where("a is not null and b is not null and a <> b").select(lo.alias("lo"), hi.alias("hi")).distinct())
    seen = None
    for _ in range(most_rounds):
        sign = edges.agg(F.count("*"), F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)"))).first()
        if sign == seen or not sign[0]:
            break
        seen = sign
        both = edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")).union(edges.select("hi", "lo"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, F.col("u") == F.col("w")).where("m < v").select(F.col("m").alias("lo"), F.col("v").alias("hi")).distinct()
        lowest = large.groupBy("hi").agg(F.min("lo").alias("m"))
        rest = large.join(lowest.withColumnRenamed("hi", "w"), F.col("hi") == F.col("w")).where("lo <> m").select(F.col("m").alias("lo"), F.col("lo").alias("hi"))
        edges = stable(rest.union(lowest.select(F.col("m").alias("lo"), "hi")).distinct())
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    found = edges.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
    return found.union(edges.select("lo", "lo").distinct())
