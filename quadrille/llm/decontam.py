"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming lookup, weighted-shingle check.

Every benchmark item gets a 64-bit SimHash over its weighted word shingles.  Windows of the same number of words slide
over each document one word at a time, and their fingerprints are looked up in five tables of 12 or 13 bits, built from
the items of that length.  By the pigeonhole principle a window within RADIUS = 19 bits of an item agrees with it in one block
up to three bits; the tables hold all block values within two bits of an item's, a lookup tries those within one bit of the
window's, so no fingerprint within the radius is missed.  Of random fingerprints a table lookup passes 21 %, the radius one
in a thousand; a window at similarity 0.8 is beyond the radius with probability below 0.001 (expected distance 9.7
bits, deviation 2.9).  What the lookup proposes is verified with the exact weighted Jaccard similarity of the shingle multisets.

Windows are fingerprinted where they could pass: the weight of a window's shingles that occur anywhere in the benchmark bounds
its similarity with every item, so windows below the threshold by that bound have no match.  Texts are taken whole.

Shingle weights come from the whole benchmark: 1 + ln((1 + items) / (1 + items with the shingle)); one that no item has
weighs as if one had it.  The corpus is read once: a bit table of fixed size (2 MB) of the benchmark's shingles finds the
documents that may hold any, which are stored.  The items, the stated query set, reach the tasks in blocks of at most about
`block_words` words, so a broadcast is bounded whatever the benchmark's size; only the stored documents are read again.

Defined cases: null or empty texts match nothing; items that are null, empty or shorter than `n` words match nothing, as
do documents shorter than `n` words; a document shorter than an item is one window; repeated items report each item_id;
null item_ids are ignored, null doc_ids are reported as null; extra columns are ignored; empty tables give an empty result.
"""

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ._store import stored
from ._text import mix, powers, shingles, small_batches, span_hashes, string_buffers
from .toxicity import folded, token_spans

RADIUS, WIDTHS, STORED, TRIED = 19, (13, 13, 13, 13, 12), 2, 1
SHIFTS = tuple(int(x) for x in np.cumsum((0, *WIDTHS[:-1])))
COARSE = 24  # bits of a shingle's hash that name its place in the bit table
_OUT = "doc_id long, item_id long, start long, end long, hamming int, similarity double"


def signs(hashes):
    """+1/-1 per bit of each hash: an array (n, 64)."""
    return np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.int64) * 2 - 1


def fingerprints(sums):
    """64-bit SimHash of each row of bit sums."""
    return np.packbits(sums > 0, axis=1, bitorder="little").view("<u8").reshape(-1)


def near_values(bits, radius):
    """All masks of up to `radius` of `bits` bits."""
    return np.array([sum(1 << i for i in c) for r in range(radius + 1) for c in itertools.combinations(range(bits), r)], dtype=np.int64)


NEAR = {(w, r): near_values(w, r) for w in set(WIDTHS) for r in (STORED, TRIED)}


def blocks_of(prints):
    """The five block values of each fingerprint."""
    return [((prints >> np.uint64(at)) & np.uint64((1 << w) - 1)).astype(np.int64) for at, w in zip(SHIFTS, WIDTHS)]


def block_tables(prints):
    """Per block the sorted values within STORED bits of a fingerprint's, and whose they are."""
    out = []
    for w, own in zip(WIDTHS, blocks_of(prints)):
        values = (own[:, None] ^ NEAR[w, STORED][None, :]).reshape(-1)
        owner = np.repeat(np.arange(len(own)), len(NEAR[w, STORED]))
        order = np.argsort(values, kind="stable")
        out.append((values[order], owner[order]))
    return out


def lookup(tables, items, prints):
    """Pairs (window, item) that agree in a block up to STORED + TRIED bits, each once; items is how many there are."""
    pairs = []
    for w, (values, owner), own in zip(WIDTHS, tables, blocks_of(prints)):
        tries = (own[:, None] ^ NEAR[w, TRIED][None, :]).reshape(-1)
        lo, hi = np.searchsorted(values, tries), np.searchsorted(values, tries, side="right")
        many = hi - lo
        at = np.repeat(lo - np.cumsum(many) + many, many) + np.arange(many.sum())
        pairs.append(np.repeat(np.repeat(np.arange(len(own)), len(NEAR[w, TRIED])), many) * items + owner[at])
    both = np.unique(np.concatenate(pairs))
    return both // items, both % items


def token_grams(texts, n, pows=None):
    """(bytes, token starts, token ends, first token of each text, shingle hashes, which are valid)."""
    data, offs = string_buffers(texts)
    data = folded(data)
    s, e, first = token_spans(data, offs)
    h, valid = shingles(span_hashes(data, s, e, pows=pows), first, n)
    return data, offs, s, e, first, h, valid


def _item_rows(n):
    def run(batches):
        for batch in small_batches(batches):
            *_, first, h, valid = token_grams(batch.column("text"), n)
            counts = np.diff(first)
            keep = np.flatnonzero(counts >= n)
            grams = [h[first[i] : first[i + 1]][valid[first[i] : first[i + 1]]].view(np.int64) for i in keep]
            yield pa.RecordBatch.from_arrays([batch.column("item_id").take(pa.array(keep)), pa.array(counts[keep].astype(np.int64)), pa.array(grams, pa.list_(pa.int64()))], names=["item_id", "size", "grams"])

    return run


def item_index(ids, sizes, grams, every, df, total):
    """What tasks need of a block of items: shingles and weights, and by length fingerprints and lookup tables.

    every and df are the shingles of these items and the number of items with each, total the number of items, in the whole benchmark.
    """
    order = np.argsort(every)
    every, df = every[order], df[order]
    weigh_df = lambda x: np.rint(1024 * (1 + np.log((1 + total) / (1.0 + x)))).astype(np.int64)  # noqa: E731  whole numbers, so that sums over windows are exact
    index = {"ids": np.asarray(ids), "every": every, "weight": weigh_df(df), "outside": int(weigh_df(np.array([1]))[0]), "grams": [np.sort(g) for g in grams], "sizes": {}}
    for size in np.unique(sizes):
        items = np.flatnonzero(np.asarray(sizes) == size)
        prints = np.concatenate([fingerprints((signs(mix(grams[k])) * weigh(index, grams[k])[:, None]).sum(axis=0, keepdims=True)) for k in items])
        index["sizes"][int(size)] = (items, prints, block_tables(prints))
    return index


def known(index, grams):
    """Which shingles the block's items have, and where in `every`."""
    at = np.minimum(np.searchsorted(index["every"], grams), max(0, len(index["every"]) - 1))
    return (index["every"][at] == grams if len(index["every"]) else np.zeros(len(grams), bool)), at


def weigh(index, grams):
    """Weights of shingles; those outside the block weigh as those of a single item."""
    have, at = known(index, grams)
    return np.where(have, index["weight"][at], index["outside"]) if len(index["every"]) else np.full(len(grams), index["outside"])


def similarity(index, item, window):
    """Weighted Jaccard similarity of an item's and a window's shingle multisets."""
    a, ca = np.unique(index["grams"][item], return_counts=True)
    b, cb = np.unique(window, return_counts=True)
    both, x, y = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    shared = (weigh(index, both) * np.minimum(ca[x], cb[y])).sum()
    total = (weigh(index, a) * ca).sum() + (weigh(index, b) * cb).sum() - shared
    return float(shared / total) if total else 0.0


def matches(index, grams, n, threshold, n_words):
    """(item, first word, words, hamming, similarity) of one document's windows that pass; overlapping ones of an item give the best."""
    out, (have, _) = [], known(index, grams)
    hits = np.flatnonzero(have)
    if not len(hits):
        return out
    weight = weigh(index, grams)
    total, held = (np.concatenate(([0], np.cumsum(x))) for x in (weight, np.where(have, weight, 0)))
    widest = max(index["sizes"])
    low, high = max(0, int(hits[0]) - widest), min(len(grams), int(hits[-1]) + widest)
    sign = np.zeros((high - low + 1, 64), dtype=np.int64)
    np.cumsum(signs(mix(grams[low:high])) * weight[low:high, None], axis=0, out=sign[1:])
    found = {}
    for size, (items, prints, tables) in index["sizes"].items():
        size = min(size, n_words)
        width = size - n + 1  # shingles in a window
        starts = np.arange(n_words - size + 1)
        starts = starts[held[starts + width] - held[starts] >= threshold * (total[starts + width] - total[starts]) - 1e-6]
        if not len(starts):
            continue
        own = fingerprints(sign[starts + width - low] - sign[starts - low])
        window, item = lookup(tables, len(items), own)
        far = np.bitwise_count(own[window] ^ prints[item]).astype(np.int64)
        for i in np.flatnonzero(far <= RADIUS):
            k, start = int(items[item[i]]), int(starts[window[i]])
            sim = similarity(index, k, grams[start : start + width])
            if sim >= threshold:
                found.setdefault((k, size), []).append((-sim, start, int(far[i])))
    for (k, size), good in found.items():
        taken = []
        for sim, start, bits in sorted(good):
            if all(abs(start - t) >= size for t in taken):
                taken.append(start)
                out.append((k, start, size, bits, -sim))
    return out


def _filter(coarse, n):
    def run(batches):
        pows, bits = powers(1 << 21), np.unpackbits(coarse.value).astype(bool)
        for batch in small_batches(batches):
            *_, first, h, valid = token_grams(batch.column("text"), n, pows)
            hot = bits[(h >> np.uint64(64 - COARSE)).astype(np.int64)] & valid
            docs = np.unique(np.searchsorted(first, np.flatnonzero(hot), side="right") - 1)
            yield batch.take(pa.array(docs))

    return run


def _matcher(index, n, threshold):
    def run(batches):
        pows = powers(1 << 21)
        ix = index.value
        for batch in small_batches(batches):
            data, offs, s, e, first, h, _ = token_grams(batch.column("text"), n, pows)
            ids, rows, heads = batch.column("doc_id").to_pylist(), [], None
            for d in range(batch.num_rows):
                a, b = int(first[d]), int(first[d + 1])
                if b - a < n:
                    continue
                for k, start, size, bits, sim in matches(ix, h[a : b - n + 1], n, threshold, b - a):
                    if heads is None:
                        heads = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
                    base = heads[offs[d]]
                    rows.append((ids[d], int(ix["ids"][k]), int(heads[s[a + start]] - base), int(heads[e[a + start + size - 1]] - base), bits, sim))
            cols = list(zip(*rows)) if rows else [[]] * 6
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, kinds)], names=["doc_id", "item_id", "start", "end", "hamming", "similarity"])

    return run


def contamination(spark, docs, benchmark, n=5, threshold=0.8, block_words=400_000):
    """Windows of docs(doc_id, text) that repeat a benchmark(item_id, text) item.

    Rows (doc_id, item_id, start, end, hamming, similarity); start and end are code-point offsets.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    items = stored(spark, items.mapInArrow(_item_rows(n), "item_id long, size long, grams array<long>"), "items")
    size = items.agg(F.count(F.lit(1)).alias("items"), F.sum("size").alias("words")).first()
    if not size.items:
        return spark.createDataFrame([], _OUT)
    gram = items.select(F.monotonically_increasing_id().alias("row"), F.explode(F.array_distinct("grams")).alias("gram"))
    df = stored(spark, gram.groupBy("gram").agg(F.count(F.lit(1)).alias("df")), "shingles")
    places = df.select(F.shiftrightunsigned("gram", 64 - COARSE).alias("place"))
    # 2 MB whatever the benchmark: 64 places a row, at most 2**18 rows
    bits = places.groupBy(F.shiftright("place", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, int(place & 63)))").alias("bits")).toArrow()
    coarse = np.zeros(1 << (COARSE - 6), dtype="<u8")
    coarse[bits.column("word").to_numpy()] = bits.column("bits").to_numpy().astype(np.int64).view(np.uint64)
    coarse = np.packbits(np.unpackbits(coarse.view(np.uint8), bitorder="little"))
    maybe = stored(spark, docs.mapInArrow(_filter(spark.sparkContext.broadcast(coarse), n), "doc_id long, text string"), "maybe")
    blocks, out = max(1, -(-size.words // block_words)), None
    for b in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b)
        weights = df.join(part.select(F.explode("grams").alias("gram")).distinct(), "gram").toArrow() if blocks > 1 else df.toArrow()  # bounded by block_words
        part = part.toArrow()
        grams = [np.array(x, dtype=np.int64).view(np.uint64) for x in part.column("grams").to_pylist()]
        if not grams:
            continue
        index = item_index(part.column("item_id").to_pylist(), part.column("size").to_numpy(), grams, weights.column("gram").to_numpy().view(np.uint64), weights.column("df").to_numpy(), size.items)
        found = maybe.mapInArrow(_matcher(spark.sparkContext.broadcast(index), n, threshold), _OUT)
        out = found if out is None else out.unionAll(found)
    return out
