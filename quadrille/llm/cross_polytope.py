"""Embedding near-duplicates by cross-polytope hashing with multiprobe buckets.

A vector is turned by pseudo-random rotations, each three rounds of sign flips and a fast Hadamard transform; its hash is
the signed axis nearest to the turned vector.  `functions` hashes make a key, `tables` keys index a vector, and each
vector also probes the keys in which one hash takes its second nearest axis.  Vectors that meet in a bucket are verified
by their cosine in double precision, so nothing below the threshold links.

With the defaults a pair at cosine 0.981 in 64 dimensions escapes all buckets with probability below 1e-4 (measured
recall on the check tables: 1.0, on pairs made at that cosine: 1.0 of 20,000).

Defined cases: vectors that are null, empty, all zero, or hold null or non-finite components, and rows without label,
link with nothing; vectors of different length never link; equal vectors of a label are one class, linked with each
other and counted with its size; of rows that repeat a vec_id one counts; rows without vec_id are left out; extra columns
are ignored; an empty table gives an empty result.

Hot groups: equal vectors collapse in a map-side combined aggregation.  The keys of a vector depend on it alone, never on how
many share them, so what is found is the same in every table that holds a pair.  A bucket larger than `block` vectors is
split into blocks by hash (four times as large in buckets of more than `hot`, which ships fewer copies), each pair of blocks a
group of its own, and a group gives counts and a spanning forest of its links, never its pairs.  A pair that meets in several
buckets counts in the one with the smallest key only.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ._graph import connected_components
from ._store import drop_stored, stored
from ._text import mix

TABLES, FUNCTIONS, BLOCK, HOT = 12, 3, 256, 4096


def hadamard(x):
    """Fast Walsh-Hadamard transform of the rows (length a power of two), scaled to keep norms."""
    n, h = x.shape[1], 1
    while h < n:
        y = x.reshape(len(x), n // (2 * h), 2, h)
        x = np.stack((y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]), axis=2).reshape(len(x), n)
        h *= 2
    return x / np.sqrt(n)


def rotation_signs(seed, size):
    """Three rows of +1/-1 that fix a rotation."""
    bits = mix(np.arange(3 * size, dtype=np.uint64) + np.uint64((seed + 1) << 32))
    return np.where(bits >> np.uint64(63), 1.0, -1.0).reshape(3, size)


def axes(x, seed):
    """Nearest and second nearest signed axis of each vector after the rotation that seed names."""
    n, d = x.shape
    size = max(2, 1 << (d - 1).bit_length())
    y = np.zeros((n, size))
    y[:, :d] = x
    for row in rotation_signs(seed, size):
        y = hadamard(y * row)
    a = np.abs(y)
    first = a.argmax(axis=1)
    a[np.arange(n), first] = -1
    second = a.argmax(axis=1)
    return tuple((i * 2 + (y[np.arange(n), i] > 0)).astype(np.uint64) for i in (first, second))


def bucket_keys(x, salt, tables=TABLES, functions=FUNCTIONS):
    """Keys of unit vectors x: array (n, tables, 1 + functions); [:, :, 0] is the bucket, the rest are probes.

    salt (n,) tells apart vectors that must not meet.
    """
    out = np.empty((len(x), tables, 1 + functions), dtype=np.uint64)
    for t in range(tables):
        best, other = zip(*(axes(x, t * functions + f) for f in range(functions)))
        for p in range(1 + functions):
            acc = mix(salt + np.uint64(t + 1))
            for f in range(functions):
                acc = mix(acc * np.uint64(31) + (other[f] if p == f + 1 else best[f]))
            out[:, t, p] = acc
    return out


def _matrix(column):
    """Rows of an Arrow list column, grouped by length: (row indices, float64 matrix)."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    at = np.concatenate(([0], np.cumsum(sizes)))
    for d in np.unique(sizes):
        rows = np.flatnonzero(sizes == d)
        yield rows, flat[at[rows][:, None] + np.arange(d)[None, :]]


def _unit(x):
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _indexer(tables, functions):
    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                batch = whole.slice(at, 2000)
                label = batch.column("label").to_numpy().astype(np.int64).view(np.uint64)
                keys = np.zeros((batch.num_rows, tables, 1 + functions), dtype=np.uint64)
                for rows, x in _matrix(pa.concat_arrays([batch.column("embedding")])):
                    keys[rows] = bucket_keys(_unit(x), mix(label[rows]) + np.uint64(x.shape[1]), tables, functions)
                width = tables * (1 + functions)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, width * len(keys) + 1, width, dtype=np.int32)), pa.array(keys.reshape(-1).view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("copies"), batch.column("embedding"), lists], names=["vec_id", "copies", "embedding", "keys"])

    return run


def roots(n, i, j):
    """Smallest index connected with each of n indices by the links (i, j)."""
    low = np.arange(n)
    while True:
        new = low.copy()
        np.minimum.at(new, i, low[j])
        np.minimum.at(new, j, low[i])
        new = new[new]
        if (new == low).all():
            return low
        low = new


def group_links(key, ids, copies, x, keys, side, cross, threshold):
    """Per vector of a bucket (or pair of blocks): ids, linked copies, smallest linked id; each link counts in one bucket.

    keys is (n, tables, 1 + functions); side tells the two blocks apart where cross is set.
    """
    n = len(ids)
    i, j = np.nonzero(x @ x.T >= threshold)
    keep = i < j
    if cross:
        keep &= side[i] != side[j]
    i, j = i[keep], j[keep]
    good = np.zeros(len(i), dtype=bool)
    for at in range(0, len(i), 20_000):
        a, b = keys[i[at : at + 20_000]], keys[j[at : at + 20_000]]
        top = np.uint64(2**64 - 1)
        one = np.where(a[:, :, :1] == b, b, top).min(axis=(1, 2))
        two = np.where(b[:, :, :1] == a, a, top).min(axis=(1, 2))
        good[at : at + 20_000] = np.minimum(one, two) == np.uint64(key)
    i, j = i[good], j[good]
    count = np.bincount(i, weights=copies[j], minlength=n) + np.bincount(j, weights=copies[i], minlength=n)
    low = ids[roots(n, i, j)] if len(i) else ids
    some = np.flatnonzero(count)
    return ids[some], count[some].astype(np.int64), low[some]


def _linker(threshold, width):
    fields = ["vec_id", "n", "root"]

    def finish(key, parts):
        table = pa.Table.from_batches(parts).combine_chunks()
        ids = table.column("vec_id").to_numpy()
        order = np.argsort(ids, kind="stable")
        order = order[np.concatenate(([True], np.diff(ids[order]) > 0))]  # probes of a vector may meet twice
        table = table.take(pa.array(order))
        emb = table.column("embedding").combine_chunks()
        keys = table.column("keys").combine_chunks()
        k = np.array(keys.flatten().to_numpy(), dtype=np.int64).view(np.uint64).reshape(table.num_rows, -1, width)
        out = []
        for rows, x in _matrix(emb):
            out.append(group_links(np.int64(key[0]).view(np.uint64), table.column("vec_id").to_numpy()[rows], table.column("copies").to_numpy()[rows].astype(np.float64), _unit(x), k[rows], table.column("part").to_numpy()[rows], key[1] != key[2], threshold))
        return [pa.array(np.concatenate([o[c] for o in out])) for c in range(3)]

    def run(batches):
        key, parts = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            k = [batch.column(c).to_numpy() for c in ("key", "r", "s")]
            cuts = np.flatnonzero(np.any([np.diff(c) != 0 for c in k], axis=0)) + 1
            for a, b in zip(np.concatenate(([0], cuts)), np.concatenate((cuts, [batch.num_rows]))):
                now = tuple(int(c[a]) for c in k)
                if now != key and parts:
                    yield pa.RecordBatch.from_arrays(finish(key, parts), names=fields)
                    parts = []
                key = now
                parts.append(batch.slice(a, b - a))
        if parts:
            yield pa.RecordBatch.from_arrays(finish(key, parts), names=fields)

    return run


def similar_vectors(spark, vectors, threshold=0.98, tables=TABLES, functions=FUNCTIONS, block=BLOCK, hot=HOT):
    """Links between the rows of vectors(vec_id, embedding, label) with equal labels and cosine >= threshold.

    Rows (vec_id, n_links, component_id, kept): other vectors linked directly, smallest vec_id reachable, and whether it
    is the vector itself.
    """
    v = vectors.where("vec_id is not null").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    v = v.groupBy("vec_id").agg(F.min(F.struct("label", "embedding")).alias("v")).select("vec_id", "v.label", "v.embedding")
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    v = stored(spark, v.withColumn("usable", F.coalesce(F.col("label").isNotNull() & finite, F.lit(False))), "vectors")
    usable = v.where("usable")
    classes = stored(spark, usable.groupBy("label", "embedding").agg(F.min("vec_id").alias("vec_id"), F.count(F.lit(1)).alias("copies")), "classes")
    index = stored(spark, classes.mapInArrow(_indexer(tables, functions), "vec_id long, copies long, embedding array<double>, keys array<long>"), "index")
    width = 1 + functions
    slots = index.select("vec_id", F.posexplode("keys").alias("at", "key")).select("vec_id", "key", (F.col("at") % width == 0).cast("int").alias("own"))
    slots = slots.groupBy("key", "vec_id").agg(F.max("own").alias("own"))
    full = slots.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.sum("own").alias("owned")).where("size > 1 and owned > 0")
    met = slots.join(full, "key").select("key", "vec_id", F.ceil(F.col("size") / F.when(F.col("size") > hot, 4 * block).otherwise(block)).cast("int").alias("blocks"))
    met = met.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("blocks").cast("long")).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select("key", "vec_id", "part", F.least("part", "other").alias("r"), F.greatest("part", "other").alias("s"))
    groups = met.join(index, "vec_id").select("key", "r", "s", "part", "vec_id", "copies", "embedding", "keys").repartition("key", "r", "s").sortWithinPartitions("key", "r", "s")
    links = stored(spark, groups.mapInArrow(_linker(threshold, width), "vec_id long, n long, root long"), "links")
    counts = links.groupBy("vec_id").agg(F.sum("n").alias("n"))
    drop_stored(spark, index)
    parts = connected_components(spark, links.where("vec_id <> root").select(F.col("vec_id").alias("a"), F.col("root").alias("b")))
    found = classes.join(counts, "vec_id", "left").join(parts.withColumnRenamed("id", "vec_id"), "vec_id", "left")
    found = found.select("label", "embedding", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    out = usable.join(found, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    out = out.unionAll(v.where("not usable").select("vec_id", F.lit(0).cast("long"), F.col("vec_id")))
    return out.select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))
