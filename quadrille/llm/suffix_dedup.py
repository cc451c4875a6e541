"""Exact removal of repeated byte strings with suffix arrays built by induced sorting.

Each byte covered by a `length`-byte string that also starts earlier (smaller doc_id, or same document and earlier
start) is removed.  Whether a string repeats is read off suffix arrays of shards of the corpus.

1. Shards.  Every window of `length` bytes is named by an anchor: the smallest hash among the `gram`-byte strings in it.
   Equal windows have equal anchors, so anchors decide which pieces of text can repeat each other, and a document
   needs only one row for each stretch of windows with one anchor.  Anchors that occur once can't repeat anything.
2. Copies.  Stretches with equal anchor and equal bytes collapse to their first occurrence; the others are covered by
   it as a whole.  This is a combined aggregation, so thousands of copies are one row before any text moves.
3. Suffix arrays.  Where an anchor has several different stretches, the first occurrences of those that agree with another
   one around the anchor, as far as a window in common must, are concatenated, shard by shard, and sorted: suffixes are classified, leftmost-smaller substrings sorted and named, the names sorted
   recursively, and the shard's array induced from them in linear time.  Permuted common prefixes of `length` or
   more mark the suffixes that repeat an earlier one.
4. Hot anchors.  A shard holds whole anchors, so stretches of an anchor that has more than a few shards of different
   text are split first: into their windows, named by 128 bits of hash, of which all but the earliest go.  That is a
   combined aggregation again; no task sees the group.

Defined cases: null counts as empty text, with no removed bytes and the digest of nothing; texts shorter than `length`
keep all bytes; rows with the same doc_id and text are one document and one row of the result; rows with one doc_id and
different texts, or without doc_id, are documents of their own, ordered by doc_id (null first) and hash of the text;
extra columns are ignored; an empty table gives an empty result.  Bytes are those of UTF-8; what is kept need
not be valid UTF-8.
"""

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ._store import drop_stored, settle, stored
from ._text import byte_table, mix, powers, small_batches, span_hashes, string_buffers

LENGTH, GRAM = 100, 24
GRAMS, POWERS = byte_table(lower=False, seed=7), powers(1 << 10)
PARTS = 8  # ranges of windows that are compared before suffixes are sorted
SHARD, SHARDS = 2 << 20, 8  # bytes of a suffix array, and how many of them an anchor may fill


def suffix_types(s):
    """True for S suffixes (smaller than the next one) of s, whose last symbol is the unique smallest."""
    n = len(s)
    step = np.sign(np.diff(s.astype(np.int64)))
    at = np.flatnonzero(step)
    small = np.zeros(n, dtype=bool)
    small[-1] = True
    if len(at):
        nxt = np.searchsorted(at, np.arange(n - 1))
        ok = nxt < len(at)
        small[:-1][ok] = step[at[nxt[ok]]] > 0
    return small


def _induce(s, small, counts, lms):
    """Suffix array of s induced from its leftmost-smaller suffixes in the order given; bucket by bucket."""
    n, ends = len(s), np.cumsum(counts)
    starts = ends - counts
    sa = np.full(n, -1, dtype=np.int64)
    chars = np.flatnonzero(counts)
    order = np.argsort(s[lms], kind="stable")
    placed = lms[order]
    cut = np.searchsorted(s[placed], np.arange(len(counts) + 1))
    head = starts.copy()

    def spread(found, symbols, base, sign):
        o = np.argsort(symbols, kind="stable")
        c, f = symbols[o], found[o]
        many = np.bincount(c, minlength=len(counts))
        place = np.arange(len(c)) - np.repeat(np.cumsum(many) - many, many)
        sa[base[c] + sign * place] = f
        base += sign * many

    # L suffixes from left to right; a bucket's own L suffixes grow while it is read
    for c in chars:
        at = starts[c]
        while at < head[c]:
            now, at = sa[at : head[c]], head[c]
            now = now[now > 0] - 1
            now = now[~small[now]]
            spread(now, s[now], head, 1)
        now = placed[cut[c] : cut[c + 1]]
        now = now[now > 0] - 1
        now = now[~small[now]]
        if len(now):
            spread(now, s[now], head, 1)
    # S suffixes from right to left
    tail = ends - 1
    for c in chars[::-1]:
        at = ends[c] - 1
        while at > tail[c]:
            now, at = sa[tail[c] + 1 : at + 1][::-1], tail[c]
            now = now[now > 0] - 1
            now = now[small[now]]
            spread(now, s[now], tail, -1)
        now = sa[starts[c] : head[c]][::-1]
        now = now[now > 0] - 1
        now = now[small[now]]
        if len(now):
            spread(now, s[now], tail, -1)
    sa[0] = n - 1
    return sa


def _induce_names(s, small, counts, lms):
    """The same for strings over many symbols, suffix by suffix."""
    n, sa = len(s), [-1] * len(s)
    ends = np.cumsum(counts)
    head, tail, t = (ends - counts).tolist(), (ends - 1).tolist(), (ends - 1).tolist()
    v, larger = s.tolist(), np.full(n + 1, -1, dtype=np.int64)  # the symbol before each suffix; the last is for empty places
    larger[1:n] = s[:-1]
    smaller = larger.copy()
    larger[1:n][small[:-1]] = -1
    smaller[1:n][~small[:-1]] = -1
    larger, smaller = larger.tolist(), smaller.tolist()
    for i in reversed(lms.tolist()):
        sa[t[v[i]]] = i
        t[v[i]] -= 1
    for i in sa:  # grows ahead of the loop
        c = larger[i]
        if c >= 0:
            at = head[c]
            sa[at] = i - 1
            head[c] = at + 1
    for i in reversed(sa):
        c = smaller[i]
        if c >= 0:
            at = tail[c]
            sa[at] = i - 1
            tail[c] = at - 1
    return np.array(sa, dtype=np.int64)


def suffix_array(s, symbols=None):
    """Suffix array of an integer array whose last symbol is the unique smallest, 0."""
    n = len(s)
    if n < 3:
        return np.argsort(s, kind="stable").astype(np.int64)
    symbols = int(s.max()) + 1 if symbols is None else symbols
    counts, small = np.bincount(s, minlength=symbols), suffix_types(s)
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    induce = _induce if symbols <= 512 else _induce_names
    sa = induce(s, small, counts, lms)
    # names of the sorted leftmost-smaller substrings
    is_lms = np.zeros(n, dtype=bool)
    is_lms[lms] = True
    ordered = sa[is_lms[sa]]
    size = np.zeros(n, dtype=np.int64)
    size[lms[:-1]] = np.diff(lms) + 1
    size[lms[-1]] = 1
    a, b = ordered[:-1], ordered[1:]
    same = size[a] == size[b]
    live, at = np.flatnonzero(same), 0
    while len(live):
        live = live[size[a[live]] > at]
        if not len(live):
            break
        x, y = a[live] + at, b[live] + at
        equal = (s[x] == s[y]) & (small[x] == small[y])
        same[live[~equal]] = False
        live, at = live[equal], at + 1
    name = np.concatenate(([0], np.cumsum(~same)))
    if name[-1] + 1 < len(lms):
        names = np.zeros(n, dtype=np.int64)
        names[ordered] = name
        ordered = lms[suffix_array(names[lms], int(name[-1]) + 1)]
    return induce(s, small, counts, ordered)


def permuted_prefixes(s, sa, stop):
    """For each position the common prefix with the suffix before it in sa, up to the next symbol `stop` or below.

    Only positions whose left neighbours differ are compared; elsewhere the value is one less than at the position before.
    """
    n = len(s)
    before = np.full(n, -1, dtype=np.int64)
    before[sa[1:]] = sa[:-1]
    i = np.arange(n)
    left = np.zeros(n, dtype=bool)
    inner = (i > 0) & (before > 0)
    left[inner] = (s[i[inner] - 1] == s[before[inner] - 1]) & (s[i[inner] - 1] > stop)
    heads = np.flatnonzero(~left)
    value = np.zeros(n, dtype=np.int64)
    live = heads[before[heads] >= 0]
    at = 0
    while len(live):
        x, y = live + at, before[live] + at
        fine = (x < n) & (y < n)
        live, x, y = live[fine], x[fine], y[fine]
        equal = (s[x] == s[y]) & (s[x] > stop)
        live = live[equal]
        at += 1
        value[live] = at
    last = np.maximum.accumulate(np.where(~left, i, 0))
    return value[last] - (i - last)


def repeated_windows(pieces, length):
    """Which windows of the pieces (byte strings in corpus order) repeat an earlier window: (piece, offset) arrays."""
    sizes = np.array([len(p) for p in pieces], dtype=np.int64)
    s = np.ones(int(sizes.sum()) + len(pieces) + 1, dtype=np.int16)
    starts = np.concatenate(([0], np.cumsum(sizes + 1)))
    flat = np.frombuffer(b"\0".join(pieces), dtype=np.uint8)
    s[: len(flat)] = flat.astype(np.int16) + 2
    s[starts[1:-1] - 1] = 1
    s[-2:] = (1, 0)
    sa = suffix_array(s)
    long = permuted_prefixes(s, sa, 1)[sa] >= length
    group = np.cumsum(~long)
    first = np.full(group[-1] + 1, len(s), dtype=np.int64)
    np.minimum.at(first, group, sa)
    many = long.copy()
    many[:-1] |= long[1:]
    at = np.sort(sa[many & (sa != first[group])])
    piece = np.searchsorted(starts, at, side="right") - 1
    return piece, at - starts[piece]


def gram_hashes(data, gram, pows):
    """(prefix sums, hash of each `gram` bytes) of a byte array; pows are at least as many powers as bytes."""
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(GRAMS[data] * pows[0][: len(data)], out=sums[1:])
    return sums, mix((sums[gram:] - sums[:-gram]) * pows[1][: len(data) - gram + 1])


def _anchors(length, gram):
    def run(batches):
        pows = powers(1 << 21)
        width = length - gram + 1
        for batch in small_batches(batches):
            data, offs = string_buffers(batch.column("text"))
            names = ["anchor", "body", "doc", "at"]
            if len(data) < length:
                continue
            if len(pows[0]) <= len(data):
                pows = powers(len(data) + 1)
            sums, grams = gram_hashes(data, gram, pows)
            back = pows[1]
            low = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
            have = 1
            while have < width:  # smallest over the grams of each window; leftmost where equal
                step = min(have, width - have)
                low = np.minimum(low[:-step], low[step:])
                have += step
            at = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)
            ends = np.repeat(offs[1:], np.diff(offs))[: len(at)]
            valid = np.arange(len(at)) + length <= ends
            fresh = np.concatenate(([True], (at[1:] != at[:-1]) | ~valid[:-1]))
            doc_start = np.zeros(len(at) + 1, dtype=bool)
            doc_start[offs[offs <= len(at)]] = True
            lo = np.flatnonzero(valid & (fresh | doc_start[:-1]))
            if not len(lo):
                continue
            stop = np.concatenate((lo[1:], [len(at)]))
            total = np.concatenate(([0], np.cumsum(valid)))
            n = total[stop] - total[lo]  # windows from lo on; invalid ones end a document
            hi = lo + n - 1
            body = mix((sums[hi + length] - sums[lo]) * back[lo] + (at[lo] - lo).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + n.astype(np.uint64))
            doc = np.searchsorted(offs, lo, side="right") - 1
            ids = np.asarray(batch.column("doc").to_numpy(zero_copy_only=False))
            name = grams[at[lo]]
            order = np.lexsort((body, name, doc))  # stable: positions ascend among equals
            x, y, z = doc[order], name[order], body[order]
            again = np.zeros(len(lo), dtype=np.int64)
            again[order[1:]] = (x[1:] == x[:-1]) & (y[1:] == y[:-1]) & (z[1:] == z[:-1])
            packed = (lo - offs[doc]) << 17 | n << 1 | again
            yield pa.RecordBatch.from_arrays([pa.array(name.view(np.int64)), pa.array(body.view(np.int64)), pa.array(ids[doc]), pa.array(packed)], names=names)

    return run


def _pieces(length):
    def run(batches):
        for batch in batches:
            anchor, doc, at, body = [], [], [], []
            for d, text, needs in zip(*(batch.column(c).to_pylist() for c in ("doc", "text", "needs"))):
                raw = text.encode()
                for x in needs:
                    anchor.append(x["anchor"])
                    doc.append(d)
                    at.append(x["lo"])
                    body.append(raw[x["lo"] : x["lo"] + x["n"] - 1 + length])
            yield pa.RecordBatch.from_arrays([pa.array(anchor, pa.int64()), pa.array(doc, pa.int64()), pa.array(at, pa.int32()), pa.array(body, pa.binary())], names=["anchor", "doc", "lo", "body"])

    return run


def may_repeat(anchor, rows, length, gram):
    """The rows (doc, lo, piece) of an anchor that can have a window in common with another one.

    All windows hold the anchor's gram.  How far one reaches to its left falls into one of `PARTS` ranges, and a window that two
    pieces share has the bytes in common that all windows of its range hold; a piece whose bytes there are like no
    other's in any range repeats nothing, and of the others only the windows from the first such range to the last stay.
    """
    first = np.frombuffer(rows[0][2], dtype=np.uint8)
    at = np.flatnonzero(gram_hashes(first, gram, POWERS if len(first) < len(POWERS[0]) else powers(len(first) + 1))[1] == np.uint64(anchor & (1 << 64) - 1))
    if not len(at):
        return rows
    word, rest, places = rows[0][2][at[0] : at[0] + gram], length - gram, []
    for _, _, piece in rows:
        g = piece.find(word)
        if g < 0 or piece.find(word, g + 1) >= 0:
            return rows
        places.append(g)
    edges = [rest * j // PARTS for j in range(PARTS + 1)]
    shared = [[] for _ in rows]
    for j in range(PARTS):
        left, right = edges[j], gram + rest - edges[j + 1]  # bytes held to the left of the gram, from it on; two that clash keep more
        keys = [hash(r[2][g - left : g + right]) if left <= g and g + right <= len(r[2]) else None for r, g in zip(rows, places)]
        many = Counter(keys)
        for k, found in zip(keys, shared):
            if k is not None and many[k] > 1:
                found.append(j)
    out = []
    for (doc, lo, piece), g, found in zip(rows, places, shared):
        if found:
            cut = max(0, g - edges[found[-1] + 1])
            out.append((doc, lo + cut, piece[cut : g + gram + rest - edges[found[0]]]))
    return [r for r in out if len(r[2]) >= length]


def _sorter(length, gram, shard_bytes):
    """Suffix arrays over shards of whole anchors, of `shard_bytes` and what their last anchor has beyond."""

    def shard(rows):
        rows.sort(key=lambda r: (r[0], r[1]))
        piece, off = repeated_windows([r[2] for r in rows], length)
        if not len(piece):
            return []
        split = np.flatnonzero((np.diff(piece) != 0) | (np.diff(off) != 1)) + 1
        a, b = np.concatenate(([0], split)), np.concatenate((split, [len(piece)]))
        return [(rows[piece[i]][0], rows[piece[i]][1] + int(off[i]), rows[piece[i]][1] + int(off[j - 1]) + length) for i, j in zip(a, b)]

    def out(spans):
        cols = list(zip(*spans)) if spans else [[]] * 3
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int32()))], names=["doc", "start", "end"])

    def run(batches):
        rows, size, own, last = [], 0, [], None
        for batch in batches:
            for anchor, doc, lo, body in zip(*(batch.column(c).to_pylist() for c in ("anchor", "doc", "lo", "body"))):
                if anchor != last:
                    if len(own) > 1:
                        own = may_repeat(last, own, length, gram)
                        rows += own
                        size += sum(len(r[2]) for r in own)
                    own, last = [], anchor
                    if size >= shard_bytes:
                        yield out(shard(rows))
                        rows, size = [], 0
                own.append((doc, lo, body))
        if len(own) > 1:
            rows += may_repeat(last, own, length, gram)
        if rows:
            yield out(shard(rows))

    return run


def _windows(length):
    """Every window of the pieces by two hashes: rows (h1, h2, doc, start)."""

    def run(batches):
        tables, pows = (byte_table(lower=False, seed=11), byte_table(lower=False, seed=13)), powers(1 << 21)
        for batch in small_batches(batches, "body"):
            data, offs = string_buffers(batch.column("body"))
            n = np.diff(offs) - length + 1
            piece = np.repeat(np.arange(len(n)), n)
            off = np.arange(len(piece)) - np.repeat(np.cumsum(n) - n, n)
            at = offs[piece] + off
            h1, h2 = (span_hashes(data, at, at + length, table, pows=pows) for table in tables)
            doc, start = batch.column("doc").to_numpy()[piece], (batch.column("lo").to_numpy()[piece] + off).astype(np.int32)
            for j in range(0, len(at), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(x[j : j + 50_000]) for x in (h1.view(np.int64), h2.view(np.int64), doc, start)], names=["h1", "h2", "doc", "start"])

    return run


def _finisher(batches):
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
    for batch in small_batches(batches):
        rows = []
        for d, text, spans in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "spans"))):
            raw, at, parts, removed, runs, end = (text or "").encode(), 0, [], 0, 0, -1
            for p in sorted((p["start"], p["end"]) for p in spans or ()):
                if p[0] > end:
                    runs += 1
                    parts.append(raw[at : p[0]])
                    removed += p[1] - p[0]
                else:
                    removed += max(0, p[1] - end)
                end = max(end, p[1])
                at = end
            parts.append(raw[at:])
            kept = b"".join(parts)
            rows.append((d, len(raw), removed, runs, hashlib.sha256(kept).hexdigest(), kept))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), kinds)], names=names)


def repeated_spans(spark, docs, length=LENGTH, gram=GRAM, shard_bytes=SHARD):
    """Removed byte ranges of docs(doc, text), doc unique and in corpus order: rows (doc, start, end), which may overlap."""
    anchors = stored(spark, docs.mapInArrow(_anchors(length, gram), "anchor long, body long, doc long, at long"), "anchors")
    # plain numbers only, so that the aggregations hash; most anchors go before anything wider moves
    several = anchors.groupBy("anchor").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("anchor")
    again_met = stored(spark, anchors.join(several, "anchor"), "several")
    drop_stored(spark, anchors)
    del several
    settle(spark)
    kinds = again_met.groupBy("anchor").agg(F.min("body").alias("b0"), F.max("body").alias("b1"), F.min("doc").alias("first"))
    met = stored(spark, again_met.join(kinds.select("anchor", (F.col("b0") != F.col("b1")).alias("mixed"), "first"), "anchor"), "met")
    drop_stored(spark, again_met)
    del kinds
    settle(spark)
    lo, n = F.shiftright("at", 17).cast("int"), (F.shiftright("at", 1).bitwiseAND(0xFFFF)).cast("int")
    own, again = F.col("doc") == F.col("first"), F.col("at").bitwiseAND(1) == 1
    span = ["doc", lo.alias("start"), (lo + n - 1 + length).alias("end")]
    plain = met.where(~F.col("mixed") & (~own | again)).select(*span)
    mixed = met.where("mixed").select("anchor", "body", "doc", "at")
    mixed = stored(spark, mixed.join(mixed.groupBy("anchor", "body").agg(F.min("doc").alias("first")), ["anchor", "body"]), "mixed")
    copies = mixed.where(~own | again).select(*span)
    different = mixed.where(own & ~again).select("anchor", "doc", lo.alias("lo"), n.alias("n"))
    hot = stored(spark, different.groupBy("anchor").agg(F.sum(F.col("n") - 1 + length).alias("bytes")).where(F.col("bytes") > SHARDS * shard_bytes).select("anchor"), "hot")
    grouped = lambda x: docs.join(x.groupBy("doc").agg(F.collect_list(F.struct("anchor", "lo", "n")).alias("needs")), "doc").select("doc", "text", "needs")
    pieces = stored(spark, grouped(different).mapInArrow(_pieces(length), "anchor long, doc long, lo int, body binary"), "pieces")
    settle(spark)
    split = hot.limit(1).count()
    ordered = (pieces.join(hot, "anchor", "left_anti") if split else pieces).repartition("anchor").sortWithinPartitions("anchor", "doc", "lo")
    spans = plain.unionAll(copies).unionAll(ordered.mapInArrow(_sorter(length, gram, shard_bytes), "doc long, start int, end int"))
    tables = [met, mixed, pieces, hot]
    if split:
        windows = stored(spark, pieces.join(hot, "anchor", "left_semi").mapInArrow(_windows(length), "h1 long, h2 long, doc long, start int"), "windows")
        first = windows.groupBy("h1", "h2").agg(F.min(F.struct("doc", "start")).alias("first"), F.count(F.lit(1)).alias("c")).where("c > 1")
        later = windows.join(first, ["h1", "h2"]).where("doc <> first.doc or start <> first.start").select("doc", "start", (F.col("start") + length).alias("end"))
        spans, tables = spans.unionAll(later), [*tables, windows]
    spans = stored(spark, spans, "spans")
    for table in tables:
        drop_stored(spark, table)
    return spans


def _named(spark, docs):
    """docs(doc_id, text) with `doc`, unique and in corpus order: doc_id itself where it is unique, else numbers in its order."""
    clash = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("c")).where("c > 1 or doc_id is null").limit(1).count()
    if not clash:
        return docs.withColumn("doc", F.col("doc_id"))
    docs = docs.withColumn("pick", F.xxhash64("text")).groupBy("doc_id", "pick").agg(F.min("text").alias("text"))
    ids = docs.select("doc_id", "pick").repartitionByRange("doc_id", "pick").sortWithinPartitions("doc_id", "pick")
    ids = stored(spark, ids.withColumn("doc", F.monotonically_increasing_id()), "ids").select(F.col("doc_id").alias("i"), F.col("pick").alias("p"), "doc")
    return stored(spark, docs.join(ids, F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("pick") == F.col("p"))).select("doc_id", "text", "doc"), "named")


def without_repeats(spark, docs, length=LENGTH, shard_bytes=SHARD):
    """Every document of docs(doc_id, text) without its repeated bytes: (doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept)."""
    docs = _named(spark, docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")))
    spans = repeated_spans(spark, docs.select("doc", "text"), length, shard_bytes=shard_bytes)
    settle(spark)
    per = spans.groupBy("doc").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    return docs.join(per, "doc", "left").select("doc_id", "text", "spans").mapInArrow(_finisher, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
