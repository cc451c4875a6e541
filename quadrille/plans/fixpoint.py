"""Semi-naive closure and connected components of an edge table."""

from pyspark.sql import functions as F

from .store import discard, materialise


def closure(edges, start=None, max_rounds=10_000):
    """Pairs (s, o) reachable over one or more edges(s, o); with start(s), from those sources only.

    Each round joins the newest pairs with the edges, drops the known ones by anti join and stores what is left.
    """
    edges = materialise(edges.select("s", "o").where("s is not null and o is not null").distinct(), "edges")
    step = edges.select(F.col("s").alias("m"), F.col("o").alias("t"))
    known = delta = edges if start is None else materialise(edges.join(start.select("s").distinct(), "s", "left_semi"), "reach")
    parts = []
    for _ in range(max_rounds):
        found = delta.join(step, delta["o"] == step["m"]).select("s", F.col("t").alias("o")).distinct()
        delta = materialise(found.join(known, ["s", "o"], "left_anti"), "delta")
        if delta.isEmpty():
            return known
        parts.append(delta)
        known = known.unionByName(delta)
        if len(parts) >= 8:  # long chains: fold the rounds, so that a round doesn't read ever more small tables
            known = materialise(known, "known")
            discard(*parts[:-1])
            parts = []
    raise RuntimeError("closure didn't settle")


def components(pairs, max_rounds=200):
    """Smallest id reachable over pairs(a, b), in either direction: rows (id, rep).  Linear in the pairs, never their closure.

    Alternating large-star and small-star steps; every round stores its edge list and drops the one before.
    """
    now = materialise(pairs.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    mark = None
    for _ in range(max_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        ends = large.join(low, "u").select("u", "m", F.greatest("v", "m").alias("x"), F.least("v", "m").alias("y"))
        nxt = materialise(ends.select("u", F.col("m").alias("v")).unionByName(ends.select(F.col("x").alias("u"), F.col("y").alias("v"))).where("u <> v").distinct(), "links")
        found = tuple(nxt.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        discard(now)
        now = nxt
        if found == mark:
            reps = now.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("rep"))
            return reps.unionByName(reps.select(F.col("rep").alias("id"), "rep").distinct())
        mark = found
    raise RuntimeError("components didn't settle")
