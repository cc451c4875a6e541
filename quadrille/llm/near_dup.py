"""MinHash near-duplicate detection with sequential Bayesian verification.

Documents become sets of distinct word shingles.  Banded MinHash keys propose candidate pairs, the signatures of a
pair are compared in batches and the pair is dropped as soon as the posterior probability that its similarity reaches
the threshold falls below `miss`, and every survivor is verified on the full sets of both texts.

Defined cases: null and empty texts, and texts of white space only, have an empty set and link with nothing; texts with
fewer than n words have their whole sequence as one shingle; documents with equal sets form one class whose smallest
doc_id stands for it; rows that share a doc_id are one document, whose text is the one with the smallest hash; extra
columns are ignored; an empty table gives an empty result.  Null doc_ids are not rows of the result.

Hot groups: equal sets collapse by a map-side combined aggregation before anything is paired.  In a bucket every class
is paired with the bucket's smallest one first, which is linear; only classes that these links have not yet joined are
compared afterwards.  A bucket of up to `block` such classes is compared as a whole inside one task, on signatures.  Larger
ones (documents of one template, say) are taken apart exactly: two sets at the threshold share a shingle among the rarest
share of either, so their documents meet again only by their rare shingles, and groups of those that are still large
are compared block by block.  No pair leaves a task before its signatures agree, and no link is lost.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from ._graph import connected_components
from ._store import drop_stored, one_row_each, stored
from ._text import mix, powers, shingles, small_batches, span_hashes, string_buffers, word_spans

BANDS, ROWS = 24, 4
BLOCK = 256
_SIG = "doc_id long, n_shingles long, set_hi long, set_lo long, bands array<long>, sig binary"


def shingle_sets(texts, n, pows=None):
    """Per document of an Arrow string array: its distinct n-word shingle hashes as a sorted uint64 array."""
    data, offs = string_buffers(texts)
    s, e, first = word_spans(data, offs)
    h, valid = shingles(span_hashes(data, s, e, pows=pows), first, n)
    h = h[valid]
    cut = np.concatenate(([0], np.cumsum(valid)))[first]
    return [np.unique(h[a:b]) for a, b in zip(cut[:-1], cut[1:])]


def _signer(n, bands, rows):
    def run(batches):
        k = bands * rows
        seeds = mix(np.arange(1, k + 1, dtype=np.uint64))
        odd, add = (seeds >> np.uint64(32)).astype(np.uint32) | np.uint32(1), seeds.astype(np.uint32)
        pows = powers(1 << 21)
        for batch in small_batches(batches):
            batch = batch.filter(batch.column("doc_id").is_valid())
            sets = shingle_sets(batch.column("text"), n, pows)
            size = np.array([len(x) for x in sets], dtype=np.int64)
            full = np.flatnonzero(size)
            sig = np.zeros((k, len(sets)), dtype=np.uint32)
            hi, lo = np.zeros(len(sets), np.uint64), np.zeros(len(sets), np.uint64)
            if len(full):
                flat = np.concatenate([sets[i] for i in full])
                at = np.concatenate(([0], np.cumsum(size[full])[:-1]))
                hi[full] = np.add.reduceat(mix(flat), at)
                lo[full] = np.add.reduceat(mix(flat ^ np.uint64(0xA5A5A5A5A5A5A5A5)), at)
                low, high = flat.astype(np.uint32), (flat >> np.uint64(32)).astype(np.uint32)
                for j in range(k):
                    x = low * odd[j]
                    x ^= high
                    x *= odd[j - 1]
                    x += add[j]
                    sig[j, full] = np.minimum.reduceat(x, at)
            keys = np.empty((len(sets), bands), dtype=np.uint64)
            for b in range(bands):
                acc = np.full(len(sets), b + 1, dtype=np.uint64)
                for j in range(b * rows, b * rows + rows):
                    acc = mix(acc * np.uint64(31) + sig[j])
                keys[:, b] = acc
            byte = mix(sig.T.astype(np.uint64)).astype(np.uint8)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").cast(pa.int64()),
                    pa.array(size),
                    pa.array(hi.view(np.int64)),
                    pa.array(lo.view(np.int64)),
                    pa.ListArray.from_arrays(pa.array(np.arange(0, bands * len(sets) + 1, bands, dtype=np.int32)), pa.array(keys.view(np.int64).reshape(-1))),
                    pa.array([row.tobytes() for row in np.ascontiguousarray(byte)], pa.binary()),
                ],
                names=["doc_id", "n_shingles", "set_hi", "set_lo", "bands", "sig"],
            )

    return run


def posterior_bounds(k, step, threshold, miss, grid=2000):
    """For each number of compared hashes, the fewest matches that keep P(similarity >= threshold) at `miss` or more.

    Uniform prior on the similarity; one-byte signatures also agree by chance once in 256.
    """
    s = (np.arange(grid) + 0.5) / grid
    p = s + (1 - s) / 256
    out = []
    for m in range(step, k + 1, step):
        least = 0
        for hit in range(m + 1):
            like = hit * np.log(p) + (m - hit) * np.log1p(-p)
            like = np.exp(like - like.max())
            if like[s >= threshold].sum() >= miss * like.sum():
                least = hit
                break
        out.append((m, least))
    return out


def _pruner(k, step, threshold, miss):
    def run(batches):
        bounds = posterior_bounds(k, step, threshold, miss)
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.uint8).reshape(-1, k) for c in ("sig_a", "sig_b"))
            live, hits, at = np.arange(len(a)), np.zeros(len(a), dtype=np.int64), 0
            for m, least in bounds:
                hits += (a[live, at:m] == b[live, at:m]).sum(axis=1)
                keep = hits >= least
                live, hits, at = live[keep], hits[keep], m
            yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(live)) for c in ("a", "b")], names=["a", "b"])

    return run


def likely_pairs(sig, part, side, bounds):
    """Index pairs of different parts (and, where side is given, different sides) whose signatures pass all bounds."""
    m, least = bounds[0]
    found = []
    for lo in range(0, len(sig), BLOCK):
        x = sig[lo : lo + BLOCK]
        hits = np.zeros((len(x), len(sig)), dtype=np.uint8)
        for j in range(m):
            hits += x[:, j : j + 1] == sig[None, :, j]
        fine = (hits >= least) & (part[lo : lo + BLOCK, None] != part[None, :])
        if side is not None:
            fine &= side[lo : lo + BLOCK, None] != side[None, :]
        i, j = np.nonzero(fine)
        i += lo
        keep = i < j
        i, j = i[keep], j[keep]
        hits, at = hits[i - lo, j].astype(np.int64), m
        for to, need in bounds[1:]:
            hits += (sig[i, at:to] == sig[j, at:to]).sum(axis=1)
            keep = hits >= need
            i, j, hits, at = i[keep], j[keep], hits[keep], to
        found.append((i, j))
    return (np.concatenate(x) for x in zip(*found))


def _proposer(k, step, threshold, miss):
    """Pairs of each group (g, r, s) of rows (side, doc_id, part, sig) that pass the pruning, smaller doc_id first."""

    def run(batches):
        bounds, key, parts = posterior_bounds(k, step, threshold, miss), None, []

        def out():
            table = pa.Table.from_batches(parts).combine_chunks()
            ids, part, side = (table.column(c).to_numpy() for c in ("doc_id", "part", "side"))
            sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), dtype=np.uint8).reshape(-1, k)
            i, j = likely_pairs(sig, part, side if key[1] != key[2] else None, bounds)
            a, b = np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j])
            return pa.RecordBatch.from_arrays([pa.array(a[a != b]), pa.array(b[a != b])], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(c).to_numpy() for c in ("g", "r", "s")]
            cuts = np.flatnonzero(np.any([np.diff(c) != 0 for c in cols], axis=0)) + 1
            for a, b in zip(np.concatenate(([0], cuts)), np.concatenate((cuts, [batch.num_rows]))):
                now = tuple(int(c[a]) for c in cols)
                if now != key and parts:
                    yield out()
                    parts = []
                key = now
                parts.append(batch.slice(a, b - a))
        if parts:
            yield out()

    return run


def _grams(n):
    def run(batches):
        pows = powers(1 << 21)
        for batch in small_batches(batches):
            sets = shingle_sets(batch.column("text"), n, pows)
            offsets = np.concatenate(([0], np.cumsum([len(x) for x in sets]))).astype(np.int32)
            flat = np.concatenate(sets).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=["doc_id", "grams"])

    return run


def _rare(texts, n, percent):
    """Rows (g, doc_id): the rarest shingles of each document, of which any two at the threshold have one in common."""
    grams = texts.select("doc_id", "text").mapInArrow(_grams(n), "doc_id long, grams array<long>").select("doc_id", F.size("grams").alias("size"), F.explode("grams").alias("g"))
    counted = grams.join(grams.groupBy("g").agg(F.count(F.lit(1)).alias("df")), "g")
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy("df", "g"))
    return counted.withColumn("rank", rank).where(F.col("rank") <= F.col("size") - F.ceil(F.col("size") * percent / 100) + 1).where("df > 1").select("g", "doc_id")


def _blocks(groups, block):
    """Rows (g, doc_id, size) split into pairs of blocks: rows (g, r, s, side, doc_id)."""
    x = groups.withColumn("blocks", F.ceil(F.col("size") / block).cast("long")).withColumn("side", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    x = x.withColumn("other", F.explode(F.sequence(F.lit(0), (F.col("blocks") - 1).cast("int"))))
    return x.select("g", F.least("side", "other").alias("r"), F.greatest("side", "other").alias("s"), "side", "doc_id")


def _verifier(n, percent):
    def run(batches):
        pows = powers(1 << 21)
        for batch in small_batches(small_batches(batches, "text_a"), "text_b"):
            keep = []
            for x, y in zip(shingle_sets(batch.column("text_a"), n, pows), shingle_sets(batch.column("text_b"), n, pows)):
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both) and both > 0)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _verified(spark, pairs, texts, n, percent):
    """The pairs whose full sets reach the threshold."""
    text = lambda c: texts.select(F.col("doc_id").alias(c), F.col("text").alias(f"text_{c}"))
    return stored(spark, pairs.join(text("a"), "a").join(text("b"), "b").mapInArrow(_verifier(n, percent), "a long, b long"), "links")


def near_duplicates(spark, docs, n=4, percent=80, bands=BANDS, rows=ROWS, miss=1e-6, block=BLOCK):
    """Classes of near duplicates among docs(doc_id, text): rows (doc_id, n_shingles, component_id, kept).

    Two documents link when 100 * |A & B| >= percent * |A | B| for their n-word shingle sets; component_id is the
    smallest doc_id reachable over links, kept marks that document.  A link at the threshold itself escapes the bands
    with probability (1 - (percent/100)**rows)**bands, 3e-6 with the defaults, and the Bayesian pruning with about
    `miss` per comparison.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs = one_row_each(spark, docs.where("doc_id is not null"))
    sigs = stored(spark, docs.mapInArrow(_signer(n, bands, rows), _SIG), "signatures")
    full = sigs.where("n_shingles > 0")
    key = ["set_hi", "set_lo", "n_shingles"]
    classes = stored(spark, full.groupBy(*key).agg(F.min("doc_id").alias("rep")), "classes")
    reps = sigs.join(classes.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi")
    keyed = reps.select("doc_id", F.explode("bands").alias("band"))
    lead = keyed.groupBy("band").agg(F.min("doc_id").alias("lead"), F.count(F.lit(1)).alias("size")).where("size > 1")
    buckets = stored(spark, keyed.join(lead.select("band", "lead"), "band"), "buckets")
    involved = buckets.select("doc_id").distinct()
    texts = stored(spark, docs.join(involved, "doc_id", "left_semi"), "texts")
    few = stored(spark, reps.select("doc_id", "sig").join(involved, "doc_id", "left_semi"), "involved")

    k, threshold = bands * rows, percent / 100
    side = lambda c: few.select(F.col("doc_id").alias(c), F.col("sig").alias(f"sig_{c}"))
    star = buckets.where("doc_id <> lead").select(F.col("lead").alias("a"), F.col("doc_id").alias("b")).distinct()
    likely = star.join(side("a"), "a").join(side("b"), "b").mapInArrow(_pruner(k, 16, threshold, miss), "a long, b long")
    first = _verified(spark, likely, texts, n, percent)
    joined = stored(spark, connected_components(spark, first), "joined")
    parts = few.select("doc_id", "sig").join(joined.withColumnRenamed("id", "doc_id"), "doc_id", "left").select("doc_id", "sig", F.coalesce("component_id", "doc_id").alias("part"))
    parts = stored(spark, parts, "parts")
    placed = buckets.select("band", "doc_id").join(parts.select("doc_id", "part"), "doc_id")
    mixed = placed.groupBy("band").agg(F.min("part").alias("p"), F.max("part").alias("q"), F.count(F.lit(1)).alias("size")).where("p <> q").select("band", "size")
    open_ = stored(spark, placed.join(mixed, "band").select(F.col("band").alias("g"), "doc_id", "size"), "open")
    large = open_.where(F.col("size") > block).select("doc_id").distinct()
    rare = _rare(texts.join(large, "doc_id", "left_semi"), n, percent)
    rare = rare.join(rare.groupBy("g").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "g").select("g", "doc_id", "size")
    groups = _blocks(open_.where(F.col("size") <= block).unionAll(rare), block).join(parts, "doc_id")
    groups = groups.select("g", "r", "s", "side", "doc_id", "part", "sig").repartition("g", "r", "s").sortWithinPartitions("g", "r", "s")
    cross = groups.mapInArrow(_proposer(k, 16, threshold, miss), "a long, b long").distinct()
    cross = cross.join(star.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti")
    links = stored(spark, first.unionAll(_verified(spark, cross, texts, n, percent)), "links")
    for table in (buckets, texts, few, joined, parts, open_, first):
        drop_stored(spark, table)
    parts = connected_components(spark, links)

    members = full.select("doc_id", *key).join(classes, key).select("doc_id", "rep")
    found = members.join(parts.withColumnRenamed("id", "rep"), "rep", "left").select("doc_id", F.coalesce("component_id", "rep").alias("component_id"))
    out = sigs.select("doc_id", "n_shingles").join(found, "doc_id", "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), (component == F.col("doc_id")).alias("kept"))


def band_miss(similarity, bands=BANDS, rows=ROWS):
    """Probability that no band of a pair at this similarity agrees."""
    return math.pow(1 - similarity**rows, bands)
