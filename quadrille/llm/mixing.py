"""Pfair interleaving of sources to target weights, in DataFrame operations only.

Weights become whole numbers of slots: source i has a_i of the P = sum(a) slots of a period.  Block j of a source has release
time floor(j * P / a) and deadline ceil((j + 1) * P / a); in every slot the released block with the earliest deadline goes
next (ties: source order).  At full use such a schedule meets every deadline, so at every slot each source is less than one
block from its target share.  The schedule repeats each period, so it is folded once over P slots and looked up for
every block: nothing sequential grows with the data.

Given weights are taken as exact fractions: .95 and .05 are 19 and 1 of 20 slots.  Only where their common period has
more than `most_slots` slots are they rounded to whole slots of about `period`, as default weights are; then, and only then, a
weight below one slot counts as one.

A source that runs out leaves its slots empty and the others keep their proportions; every document gets a place.

Defined cases: a null source is a source of its own; null and empty texts, repeated rows and null doc_ids are rows like
others (equal rows take neighbouring places); an empty table gives an empty result; weights must be positive, sources
without a given weight raise ValueError, weights of sources without documents don't count.  There is no bound on the number
of sources; folding costs sources times slots.  The result has the mixed columns only, whatever else the input carries.
"""

import math
from fractions import Fraction

from pyspark.sql import Window
from pyspark.sql import functions as F

NULL_SOURCE = "\u0000"
SLOTS_AT_ONCE = 10_000


def whole_slots(weights, most_slots=20_000):
    """Slots of each weight in their common period, exactly in proportion; None where that period is longer than most_slots."""
    exact = {k: Fraction(repr(v) if isinstance(v, float) else v) for k, v in weights.items()}
    scale = math.lcm(*(x.denominator for x in exact.values())) if exact else 1
    whole = {k: int(x * scale) for k, x in exact.items()}
    common = math.gcd(*whole.values()) if whole else 1
    whole = {k: v // common for k, v in whole.items()}
    return whole if sum(whole.values()) <= most_slots else None


def source_slots(counts, weights=None, period=1000):
    """Slots per source: rows (source_key, n, a, k, p); k numbers the sources in order from 1, p is the period.

    counts has (source_key, n).  weights maps a source to its target weight; without it the target is the square root of the
    source's size in whole slots, of `period` or of ten times the number of sources, one at least.
    """
    everything = Window.partitionBy()
    slots = whole_slots(weights) if weights else None
    chosen = slots or weights
    if chosen:
        pairs = [F.lit(x) for k, v in chosen.items() for x in (NULL_SOURCE if k is None else k, v if slots else float(v))]
        w = F.create_map(*pairs)[F.col("source_key")]
    else:
        w = F.sqrt(F.col("n").cast("double"))
    d = counts.select("source_key", "n", w.alias("w")).withColumn("k", F.row_number().over(Window.partitionBy().orderBy("source_key")))
    if not slots:
        about = F.greatest(F.lit(period), 10 * F.count(F.lit(1)).over(everything))
        d = d.withColumn("w", F.greatest(F.lit(1.0), F.round(about * F.col("w") / F.sum("w").over(everything))))
    return d.select("source_key", "n", F.col("w").cast("long").alias("a"), "k").withColumn("p", F.sum("a").over(everything))


def schedule(slots):
    """One period by earliest deadline first: rows (t, k, j): source k has its block j of the period in slot t."""
    one = slots.agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "a"))), lambda x: x["a"]).alias("a_all"), F.max("p").alias("p"), F.max("k").alias("most"))
    a, p, base = (lambda i: F.element_at("a_all", i.cast("int"))), F.col("p"), F.col("most") + 1

    def urgency(done, t):
        def of(c, i):
            k = i + 1
            due = F.floor(((c + 1) * p + a(k) - 1) / a(k))
            return F.when(F.floor(c * p / a(k)) <= t, due * base + k).otherwise(F.lit(1 << 62))

        return F.array_min(F.transform(done, of))

    def step(state, t):
        def serve(k):
            done = F.transform(state["done"], lambda c, i: c + F.when(i + 1 == k, 1).otherwise(0).cast("long"))
            return F.struct(done.alias("done"), F.concat(state["log"], F.array(k)).alias("log"))

        return F.element_at(F.transform(F.array(F.pmod(urgency(state["done"], t), base).cast("int")), serve), 1)  # so that the urgency is found once

    start = F.struct(F.transform("a_all", lambda x: F.lit(0).cast("long")).alias("done"), F.expr("cast(array() as array<int>)").alias("log"))
    folded = one.where(F.size("a_all") > 0).select(F.aggregate(F.sequence(F.lit(0).cast("long"), p - 1), start, step).alias("f"))
    rows = folded.select(F.posexplode("f.log").alias("t", "k"))
    return rows.select(F.col("t").cast("long").alias("t"), "k", (F.row_number().over(Window.partitionBy("k").orderBy("t")) - 1).cast("long").alias("j"))


def places(buckets, block):
    """Where the blocks of each bucket of a source go: buckets with `at`, an array of (b, slot, start) by block.

    buckets has (source_key, bucket, c, offset, n, a, k, p).  start is the number of documents in earlier slots: sums over
    runs of slots, then inside each run.
    """
    blocks = buckets.withColumn("b", F.explode(F.sequence(F.floor(F.col("offset") / block), F.floor((F.col("offset") + F.col("c") - 1) / block))))
    blocks = blocks.withColumn("j", F.pmod("b", "a")).join(schedule(buckets.select("k", "a", "p").distinct()), ["k", "j"])
    blocks = blocks.withColumn("slot", F.floor(F.col("b") / F.col("a")) * F.col("p") + F.col("t"))
    # a block across two buckets counts in the one that holds its first document
    blocks = blocks.withColumn("docs", F.when(F.col("b") * block >= F.col("offset"), F.least(F.lit(block), F.col("n") - F.col("b") * block)).otherwise(0).cast("long"))
    blocks = blocks.select("source_key", "bucket", "b", "slot", "docs", F.floor(F.col("slot") / SLOTS_AT_ONCE).alias("run"))
    earlier = F.sum("docs").over(Window.partitionBy("run").orderBy("slot").rangeBetween(Window.unboundedPreceding, -1))
    before = blocks.groupBy("run").agg(F.sum("docs").alias("d")).select("run", F.coalesce(F.sum("d").over(Window.partitionBy().orderBy("run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    placed = blocks.withColumn("earlier", F.coalesce(earlier, F.lit(0))).join(before, "run")
    at = placed.groupBy("source_key", "bucket").agg(F.sort_array(F.collect_list(F.struct("b", "slot", (F.col("base") + F.col("earlier")).alias("start")))).alias("at"))
    return buckets.select("source_key", "bucket", "offset").join(at, ["source_key", "bucket"])


def mix(spark, docs, weights=None, block=32, period=1000, rows_per_bucket=20_000, keep=()):
    """Place of every document in the mixture: rows (doc_id, source, *keep, slot, position).

    block is the number of documents in a block, slot the block's slot, position the document's place in the mixture
    from 0.  Inside a source the order is by md5 of doc_id.  Rows are numbered in hash buckets of about
    `rows_per_bucket` rows with summed offsets, so a source with a third of all rows is still many tasks; texts move once.
    """
    d = docs.select(*dict.fromkeys(["doc_id", "source", *keep])).withColumn("source_key", F.coalesce(F.col("source").cast("string"), F.lit(NULL_SOURCE)))
    d = d.withColumn("order_key", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")))
    counts = d.groupBy("source_key").agg(F.count(F.lit(1)).alias("n"))
    if weights:
        known = [NULL_SOURCE if k is None else k for k in weights]
        missing = [r.source_key for r in counts.where(~F.col("source_key").isin(known)).select("source_key").limit(5).collect()]
        if missing or min(weights.values()) <= 0:
            raise ValueError(f"every source needs a positive weight; none for {missing}")
        there = {r.source_key for r in counts.select("source_key").collect()}  # no more than the weights given
        weights = {k: v for k, v in weights.items() if (NULL_SOURCE if k is None else k) in there}
    largest = counts.agg(F.max("n")).first()[0] or 0
    buckets = max(1, -(-largest // rows_per_bucket))
    d = d.withColumn("bucket", F.floor(F.conv(F.substring("order_key", 1, 8), 16, 10).cast("double") * buckets / float(1 << 32)).cast("int"))
    sums = Window.partitionBy("source_key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    held = d.groupBy("source_key", "bucket").agg(F.count(F.lit(1)).alias("c")).withColumn("offset", F.coalesce(F.sum("c").over(sums), F.lit(0)))
    table = places(held.join(source_slots(counts, weights, period), "source_key"), block)

    ties = [F.col(c) for c in keep if c not in ("doc_id", "source")]
    numbered = d.withColumn("r", F.row_number().over(Window.partitionBy("source_key", "bucket").orderBy("order_key", "doc_id", F.xxhash64(*ties) if ties else F.lit(0))) - 1)
    numbered = numbered.join(table, ["source_key", "bucket"]).withColumn("r", F.col("r") + F.col("offset")).withColumn("b", F.floor(F.col("r") / block))
    place = F.element_at("at", (F.col("b") - F.floor(F.col("offset") / block) + 1).cast("int"))
    return numbered.select("doc_id", "source", *[c for c in keep if c not in ("doc_id", "source")], place["slot"].alias("slot"), (place["start"] + F.col("r") - F.col("b") * block).alias("position"))


ORACLE = """
WITH RECURSIVE d AS (SELECT doc_id, source, coalesce(source, chr(0)) AS source_key FROM documents),
src AS (SELECT source_key, count(*) AS n, sqrt(count(*)) AS w FROM d GROUP BY 1),
quota AS (SELECT source_key, greatest(1, round(greatest(1000, 10 * (SELECT count(*) FROM src)) * w / (SELECT sum(w) FROM src)))::BIGINT AS a FROM src),
per AS (SELECT sum(a)::BIGINT AS p FROM quota),
win AS (
  SELECT source_key, g.j, (g.j * p) // a AS release, ((g.j + 1) * p + a - 1) // a AS due
  FROM quota, per, LATERAL (SELECT unnest(range(a)) AS j) g
),
ranked AS (SELECT *, row_number() OVER (ORDER BY due, source_key) AS urgency FROM win),
edf AS (
  SELECT 0::BIGINT AS t, (SELECT list(urgency) FILTER (WHERE release = 0) FROM ranked) AS waiting, NULL::BIGINT AS served
  UNION ALL
  SELECT t + 1, list_concat(list_filter(waiting, lambda x: x <> list_min(waiting)),
      coalesce((SELECT list(urgency) FROM ranked WHERE release = edf.t + 1), [])), list_min(waiting)
  FROM edf WHERE t < (SELECT p FROM per)
),
sched AS (SELECT t - 1 AS t, source_key, j FROM edf JOIN ranked ON urgency = served),
numbered AS (SELECT doc_id, source, source_key, row_number() OVER (PARTITION BY source_key ORDER BY md5(doc_id::VARCHAR), doc_id) - 1 AS r FROM d),
placed AS (
  SELECT doc_id, source, r, (r // 32 // a) * p + t AS slot
  FROM numbered JOIN quota USING (source_key) CROSS JOIN per
  JOIN sched ON sched.source_key = numbered.source_key AND sched.j = (r // 32) % a
)
SELECT doc_id, source, slot::BIGINT AS slot, (row_number() OVER (ORDER BY slot, r) - 1)::BIGINT AS position FROM placed
"""
