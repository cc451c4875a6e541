"""Connected components by alternating large-star and small-star over DataFrames."""

from pyspark.sql import functions as F

from ._store import drop_stored, stored


def connected_components(spark, edges, max_rounds=60):
    """Smallest reachable id per vertex of the edges (a, b): rows (id, component_id).

    Each round is a handful of hash aggregations on (vertex, neighbour) longs; the edge list is stored after each
    round, so neither lineage nor driver memory grows.  Rounds are logarithmic in the longest path.  Empty input
    gives an empty result; self-loops and repeated edges are ignored.
    """
    now = stored(spark, edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "cc")
    mark = None
    for _ in range(max_rounds):
        both = now.select("u", "v").unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low2, "u").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        nxt = stored(spark, small, "cc")
        s = nxt.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        drop_stored(spark, now)
        now = nxt
        if tuple(s) == mark:
            break
        mark = tuple(s)
    else:
        raise RuntimeError("components didn't settle")
    return now.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("component_id"))
