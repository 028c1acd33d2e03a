"""Connected components of a graph given by its edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import staged


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(node, root) of every node of the edges, root the smallest node it is connected to.

    Large-star and small-star steps alternate, each a pair of aggregations, until the edges no longer change; every
    round is written to the shared folder. Rows with a null end, loops and repeated edges count for nothing but the node
    itself. A node with very many edges is no single task: minima are pre-aggregated, and the joins that hand them out
    are split by adaptive skew handling.
    """
    given = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null")
    nodes = given.select(F.col("u").alias("node")).union(given.select("v")).distinct()
    stars = staged(given.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    signature = None
    for _ in range(rounds):
        both = stars.union(stars.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        stars = staged(small.union(low.select("u", F.col("m").alias("v"))).distinct(), instead_of=stars)
        now = stars.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == signature:
            break
        signature = now
    else:
        raise RuntimeError(f"components not found in {rounds} rounds")
    return nodes.join(stars.select(F.col("u").alias("node"), F.col("v").alias("root")), "node", "left").select("node", F.coalesce("root", "node").alias("root"))
