"""Connected components of an edge table, by alternating large-star and small-star steps."""

from pyspark.sql import DataFrame, functions as F

from tagmill.operators.common import materialize


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """``node`` and ``component`` (the smallest node of its component) of every node with an edge.

    Each step replaces the edges by others between the same components, at most as many: nodes are linked to the smallest
    neighbour, until all edges are stars. Steps are a grouped minimum and a join, so a
    node with very many edges is not gathered anywhere; loops and repeated edges are fine.
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        """``e`` has u > v. Large: link larger neighbours to the smallest one; small: the others."""
        if large:
            both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        else:
            both = e
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        joined = both.join(low.hint("merge"), "u")  # a broadcast a step would stay in the driver's heap until it is collected
        if large:
            out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        return materialize(out.where("u <> v").distinct())

    e = materialize(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())
    before = None
    for _ in range(rounds):
        e = star(star(e, True), False)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select("v", "v").distinct())
