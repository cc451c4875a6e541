"""Ziv-Merhav scores against the whole reference, however large.

A document is cut greedily into the longest phrases that a reference document of its language holds, as the automaton of
ziv_merhav.py does for one that fits a task; phrases run through the document to its end, and it is never its own reference.

How long the match at a word is, up to eight words, comes from the hashes of its n-grams: those of 2, 3, 4 and more words
meet in buckets of hashes, and of each gram's documents the smallest and largest in the reference say whether another one than
the asking document holds it.  Positions whose gram no other document has are out from then on.  What matches eight words or more lies
in runs of such positions, and a phrase ends no later than its run does.  So a phrase that starts in a run asks for its
length: places of the reference with the same eight words send the words that follow, sorted, and the neighbours in that order hold
the longest match.  The parse goes on as if a match lasted to the end of its run and is repeated where that was wrong.  Once
the places that share eight words with the documents still open are few, each of those is parsed beside the words at all of them.

Grams are compared by 55 bits of hash in a bucket.  Defined cases as in ziv_merhav.py.
"""

import bisect
import hashlib
import time

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ._store import beside, drop_stored, settle, shared_dir, stored
from ._text import MULT, mix, small_batches
from .ziv_merhav import own_phrases, words_of

LEVELS, LONG = ((2,), (3,), (4, 5), (6, 7, 8)), 8
BUCKET = 1 << 20  # about the most grams in a bucket
CHUNK = 1 << 22  # bytes of text whose grams are packed together
LONG_WORD = 256
FEW = 200_000  # the most documents that are looked for by a broadcast of their numbers
PAIRS = 1 << 21  # the most places of others, counted for each open document, whose words are brought together to end the rounds


def table(rows, kinds):
    cols = list(zip(*rows)) if rows else [[]] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, kinds.values())], names=list(kinds))


def _texter(batches):
    """Rows of CHUNK_ROW, a chunk each: its documents and their words in lower case with one space between, packed once for all that read them."""
    from pyspark import TaskContext

    chunk = TaskContext.get().partitionId() << 20
    for batch in small_batches(batches, most=CHUNK):
        texts, counts, own = [], [], []
        for words in map(words_of, batch.column("text").to_pylist()):
            counts.append(len(words))
            own.append(own_phrases(words))
            if words:
                texts.append(" ".join(words))
        text = " ".join(texts).encode()
        docs = (batch.column(c).to_pylist() for c in ("doc_id", "lang", "good", "odd"))
        yield table([(chunk, sum(counts), *docs, counts, own, len(text), pa.Codec("zstd", 3).compress(text, asbytes=True))], CHUNK_ROW)
        chunk += 1


def word_hashes(text):
    """64-bit hashes of the words of a text with one space between, eight bytes at a time; words of over LONG_WORD bytes one by one."""
    if not text:
        return np.zeros(0, np.uint64)
    data = np.frombuffer(text, np.uint8)
    gaps = np.flatnonzero(data == 32)
    start, end = np.concatenate(([0], gaps + 1)), np.concatenate((gaps, [len(data)]))
    size = end - start
    eights = np.ndarray((len(data),), "<u8", text + bytes(8), 0, (1,))  # the eight bytes from each place on
    mask = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)
    h = mix((eights[start] & mask[np.minimum(size, 8)]) + size.astype(np.uint64) * np.uint64(MULT))
    at = np.flatnonzero((size > 8) & (size <= LONG_WORD))
    done = 8
    while len(at):
        h[at] = mix(h[at] * np.uint64(MULT) + (eights[start[at] + done] & mask[np.minimum(size[at] - done, 8)]))
        done += 8
        at = at[size[at] > done]
    for i in np.flatnonzero(size > LONG_WORD).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(text[start[i] : end[i]], digest_size=8).digest(), "little")
    return h


def salt(lang):
    return np.uint64(int.from_bytes(hashlib.blake2b(lang.encode("utf-8", "replace"), digest_size=8).digest(), "little"))


def grams(words, salts, at, k):
    """Hashes of the k words at each place, apart for each language and k."""
    acc = salts + np.uint64(k)
    for j in range(k):
        acc = acc * np.uint64(MULT) + words[at + j]
    return mix(acc)


def packed(steps):
    """Two bytes a step where that is enough, else four."""
    return steps.astype("<u2" if steps.max() <= 0xFFFF else "<u4").tobytes()


class Chunk:
    """Documents of a chunk: their words' hashes one after the other, and how long the matches known so far are."""

    def __init__(self, row, replies):
        self.number, self.ids, self.langs, self.odd, self.own, counts = (row[c] for c in ("chunk", "ids", "langs", "odd", "own", "counts"))
        self.first = np.concatenate(([0], np.cumsum(np.array(counts, np.int64))))
        self.words = word_hashes(pa.Codec("zstd").decompress(row["text"], row["size"], asbytes=True))
        self.doc, self.end = np.repeat(np.arange(len(counts)), counts), np.repeat(self.first[1:], counts)
        salts = {x: salt(x) for x in set(self.langs)}
        self.salts = np.array([salts[x] for x in self.langs], dtype=np.uint64)
        self.good = np.array(row["good"], dtype=bool)
        self.match, used = np.zeros(len(self.words), np.uint8), {}
        for level, start, steps, ok, n in replies:  # by growing level
            pos = start + np.cumsum(np.frombuffer(steps, "<u2" if len(steps) == 2 * n else "<u4").astype(np.int64))
            used.setdefault(level, []).append(pos)
            self.match[pos[np.unpackbits(np.frombuffer(ok, np.uint8), count=len(pos)).astype(bool)]] = level
        self.used = {k: np.sort(np.concatenate(x)) for k, x in used.items()}

    def messages(self, levels, before, buckets):
        """Rows (bucket, chunk, level, hashes, start, steps, docs, odd): the grams at places that `before` left, by bucket."""
        live, rows = np.arange(len(self.words)) if before is None else self.used.get(before, np.zeros(0, np.int64)), []
        odd = b"".join(np.array([k, x], "<i8").tobytes() for k, x in enumerate(self.odd) if x is not None)
        for k in levels:
            at = live[live + k <= self.end[live]]
            if not len(at):
                continue
            h = grams(self.words, self.salts[self.doc[at]], at, k)
            bucket = ((h >> np.uint64(32)) % np.uint64(buckets)).astype(np.uint16 if buckets <= 1 << 16 else np.int32)
            order = np.argsort(bucket, kind="stable")
            at, edges = at[order], np.concatenate(([0], np.cumsum(np.bincount(bucket, minlength=buckets))))
            doc, full = self.doc[at], np.flatnonzero(np.diff(edges))
            h = ((h[order] & np.uint64((1 << 56) - 2)) | self.good[doc]).astype("<u8", copy=False).view(np.uint8)
            h = np.ascontiguousarray(h.reshape(-1, 8)[:, :7])  # at once: slices of seven in eight bytes are slow to copy
            steps, docs = np.diff(at, prepend=0), np.diff(doc, prepend=0)
            first = edges[full]
            steps[first], docs[first] = 0, doc[first]
            docs = docs.astype("<u2")
            if steps.max() <= 0xFFFF:
                steps = steps.astype("<u2")
            for x, a, b in zip(full.tolist(), first.tolist(), edges[full + 1].tolist()):
                rows.append((x, self.number, k, h[a:b].tobytes(), int(at[a]), steps[a:b].tobytes() if steps.itemsize == 2 else packed(steps[a:b]), docs[a:b].tobytes(), odd))
        return rows


def _chunks(batches):
    """Chunks from rows sorted by chunk, kind (0 replies, 1 chunks) and k."""
    replies, small = [], ("k", "start", "steps", "ok", "size")
    for batch in batches:
        both = zip(*(batch.column(c).to_pylist() for c in small)) if "steps" in batch.schema.names else [None] * batch.num_rows
        for i, (kind, reply) in enumerate(zip(batch.column("kind").to_pylist(), both)):
            if kind:
                yield Chunk({c: batch.column(c)[i].as_py() for c in CHUNK_ROW}, replies)
                replies = []
            else:
                replies.append(reply)


LONGS, INTS, STRINGS, BOOLS = (pa.list_(x) for x in (pa.int64(), pa.int32(), pa.string(), pa.bool_()))
CHUNK_ROW = {"chunk": pa.int64(), "words": pa.int64(), "ids": LONGS, "langs": STRINGS, "good": BOOLS, "odd": LONGS, "counts": INTS, "own": INTS, "size": pa.int32(), "text": pa.binary()}
MESSAGE = {"bucket": pa.int32(), "chunk": pa.int64(), "level": pa.int32(), "hashes": pa.binary(), "start": pa.int32(), "steps": pa.binary(), "docs": pa.binary(), "odd": pa.binary()}
REPLY = {"chunk": pa.int64(), "k": pa.int32(), "start": pa.int32(), "steps": pa.binary(), "ok": pa.binary(), "size": pa.int32()}  # size: places here, bytes of text in a chunk
DOC = {"row": pa.int64(), "doc_id": pa.int64(), "lang": pa.string(), "good": pa.bool_(), "ident": pa.int64(), "n": pa.int64(), "own": pa.int64(), "phrases": pa.int64(), "match": pa.binary(), "at": pa.binary(), "words": pa.binary()}
ASK = {"row": pa.int64(), "phrases": pa.int64(), "ident": pa.int64(), "key": pa.int64(), "p": pa.int32(), "follow": pa.binary()}
OFFER = "key long, row long, p int"
SQL = {pa.int32(): "int", pa.int64(): "long", pa.string(): "string", pa.binary(): "binary", pa.bool_(): "boolean"}
SQL |= {pa.list_(x): f"array<{n}>" for x, n in SQL.items()}


def schema(kinds):
    return ", ".join(f"`{n}` {SQL[t]}" for n, t in kinds.items())


def _sender(levels, before, buckets):
    def run(batches):
        rows, held = [], 0
        for c in _chunks(batches):
            new = c.messages(levels, before, buckets)
            rows, held = rows + new, held + sum(len(r[3]) for r in new)
            if held > 1 << 23:
                yield table(rows, MESSAGE)
                rows, held = [], 0
        yield table(rows, MESSAGE)

    return run


def answered(values, ident):
    """(used, ok) of grams with the reference's bit lowest: another document has it too, one of the reference among them; another one of the reference has it."""
    used, ok = np.zeros(len(values), bool), np.zeros(len(values), bool)
    order = np.argsort(values >> np.uint64(1))
    v = values[order] >> np.uint64(1)
    same = v[1:] == v[:-1]
    several = np.concatenate((same, [False])) | np.concatenate(([False], same))
    order, v = order[several], v[several]
    if not len(v):
        return used, ok
    start = np.flatnonzero(np.concatenate(([True], v[1:] != v[:-1])))
    size, me = np.diff(np.concatenate((start, [len(v)]))), ident[order]
    good = (values[order] & np.uint64(1)).astype(bool)
    low, high = (np.repeat(f.reduceat(np.where(good, me, x), start), size) for f, x in ((np.minimum, np.iinfo(np.int64).max), (np.maximum, np.iinfo(np.int64).min)))
    some, apart = low <= high, np.repeat(np.minimum.reduceat(me, start) != np.maximum.reduceat(me, start), size)
    used[order], ok[order] = some & apart, some & ((low != me) | (high != me))
    return used, ok


def _resolver(batches):
    """Replies to the messages of a bucket: which places go on, and which of them match."""
    held, parts = None, []

    def out():
        values, idents = [], []
        for _, _, hashes, _, _, docs, odd in parts:
            wide = np.zeros((len(hashes) // 7, 8), np.uint8)
            wide[:, :7] = np.frombuffer(hashes, np.uint8).reshape(-1, 7)
            values.append(wide.view("<u8").reshape(-1))
        for chunk, _, _, _, _, docs, odd in parts:
            doc = np.cumsum(np.frombuffer(docs, "<u2").astype(np.int64))
            ident = doc | chunk << 16
            if odd:
                pairs = np.frombuffer(odd, "<i8").reshape(-1, 2)
                where = np.minimum(np.searchsorted(pairs[:, 0], doc), len(pairs) - 1)
                ident = np.where(pairs[where, 0] == doc, pairs[where, 1], ident)
            idents.append(ident)
        used, ok = answered(np.concatenate(values), np.concatenate(idents))
        a, rows = 0, []
        for (chunk, level, _, start, steps, _, _), v in zip(parts, values):
            b = a + len(v)
            u = np.flatnonzero(used[a:b])
            if len(u):
                pos = (start + np.cumsum(np.frombuffer(steps, "<u2" if len(steps) == 2 * len(v) else "<u4").astype(np.int64)))[u]
                rows.append((chunk, level, int(pos[0]), packed(np.diff(pos, prepend=pos[0])), np.packbits(ok[a:b][u]).tobytes(), len(u)))
            a = b
        return table(rows, REPLY)

    for batch in batches:
        for at in range(0, batch.num_rows, 200):
            for bucket, *part in zip(*(batch.column(c).slice(at, 200).to_pylist() for c in range(len(MESSAGE)))):
                if bucket != held and parts:
                    yield out()
                    parts = []
                held = bucket
                parts.append(part)
    if parts:
        yield out()


def last_of_run(at):
    """For each of some growing places the last that follows it without a gap."""
    if not len(at):
        return at
    last = np.flatnonzero(np.concatenate((np.diff(at) != 1, [True])))
    return np.repeat(at[last], np.diff(np.concatenate(([-1], last))))


def run_ends(match):
    """For each place in a run of matches of LONG words or more the run's last place."""
    at, ends = np.flatnonzero(match == LONG), np.full(len(match), -1, np.int64)
    ends[at] = last_of_run(at)
    return ends


def parse(match, ends, known, ahead):
    """(phrases, places whose matches have to be looked up) of a document; `known` has lengths of matches by place.

    Where a match ended inside its run, up to `ahead` of the next places and of others at its length's distance are looked up too.
    """
    p, c, n, asked, match, last = 0, 0, len(match), [], match.tobytes(), None
    while p < n:
        c += 1
        k = match[p]
        if k < LONG:
            p += k or 1
            continue
        end = int(ends[p])
        if end == p:
            p += LONG
        elif p in known:
            last = (end, known[p])
            p += known[p]
        else:
            asked.append(p)
            if last and last[0] == end:
                near = p + min(ahead, min(1 << 20, ahead << 8) // (end + LONG - p))  # so that the words sent stay few
                more = {*range(p + 1, min(end, near) + 1), *range(p + last[1], min(end, p + last[1] * ahead) + 1, last[1])}
                asked += sorted(x for x in more if x not in known)
            p = end + LONG
    return c, asked


def _documents(batches):
    """Per document its phrases, or what it takes to find them; the words of its runs, where others need or it needs them."""
    for c in _chunks(batches):
        rows, place = [], c.used.get(LONG, np.zeros(0, np.int64))
        edges = np.searchsorted(place, c.first)
        for i, odd in enumerate(c.odd):
            a, b = int(c.first[i]), int(c.first[i + 1])
            mine, at = c.match[a:b], place[edges[i] : edges[i + 1]] - a
            phrases, asked = parse(mine, run_ends(mine), {}, 0)
            runs = words = None
            if len(at) and (c.good[i] or asked):
                new = np.flatnonzero(np.concatenate(([True], np.diff(at) > LONG)))  # runs whose words overlap or touch are kept as one
                spans = np.stack((at[new], at[np.concatenate((new[1:] - 1, [len(at) - 1]))] + LONG), axis=1)
                runs = np.concatenate((spans.reshape(-1), at)).astype("<i4").tobytes()
                runs = len(spans).to_bytes(4, "little") + runs
                words = np.concatenate([c.words[a + x : a + y] for x, y in spans.tolist()]).astype("<u8").tobytes()
            row = c.number << 16 | i
            rows.append((row, c.ids[i], c.langs[i], bool(c.good[i]), row if odd is None else odd, b - a, c.own[i], None if asked else phrases, mine.tobytes() if asked else None, runs, words))
        yield table(rows, DOC)


class Runs:
    """The stored words of a document's runs by their places."""

    def __init__(self, at, words, lang):
        spans, at = int.from_bytes(at[:4], "little"), np.frombuffer(at, "<i4", offset=4).astype(np.int64)
        self.spans, self.at = at[: 2 * spans].reshape(-1, 2), at[2 * spans :]
        self.words, self.lang = np.frombuffer(words, "<u8"), lang
        self.begin = np.concatenate(([0], np.cumsum(self.spans[:, 1] - self.spans[:, 0])))[:-1]

    def offset(self, p):
        which = np.searchsorted(self.spans[:, 0], p, side="right") - 1
        return self.begin[which] + p - self.spans[which, 0]

    def keys(self, p):
        p = np.asarray(p, dtype=np.int64)
        return grams(self.words, np.full(len(p), salt(self.lang)), self.offset(p), LONG).view(np.int64)

    def follows(self, p, end):
        """For each place of p the words after the first LONG ones and before its end, as bytes that sort."""
        p, text = np.asarray(p, dtype=np.int64), self.words.astype(">u8").tobytes()
        a = 8 * (self.offset(p) + LONG)
        return [text[x:y] for x, y in zip(a.tolist(), (a + 8 * (end - p - LONG)).tolist())]


def _offerer(batches):
    """Rows (key, row, p): places of the reference by the hash of their first LONG words."""
    for batch in batches:
        for row, lang, at, words in zip(*(batch.column(c).to_pylist() for c in ("row", "lang", "at", "words"))):
            runs = Runs(at, words, lang)
            yield pa.RecordBatch.from_arrays([pa.array(runs.keys(runs.at)), pa.array(np.full(len(runs.at), row)), pa.array(runs.at.astype(np.int32))], names=["key", "row", "p"])


def _asker(ahead):
    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                rows = []
                for row, lang, ident, match, at, words, known in zip(*(batch.slice(i, 500).column(c).to_pylist() for c in ("row", "lang", "ident", "match", "at", "words", "known"))):
                    match = np.frombuffer(match, np.uint8)
                    ends = run_ends(match)
                    phrases, asked = parse(match, ends, {x["p"]: x["length"] for x in known or ()}, ahead)
                    if not asked:
                        rows.append((row, phrases, ident, None, None, None))
                        continue
                    runs = Runs(at, words, lang)
                    rows += [(row, None, ident, key, p, follow) for p, key, follow in zip(asked, runs.keys(asked).tolist(), runs.follows(asked, ends[asked] + LONG))]
                yield table(rows, ASK)

    return run


def _follower(batches):
    """Rows (key, ident, follow) of the places asked for; none longer than the longest question needs."""
    kinds = {"key": pa.int64(), "ident": pa.int64(), "follow": pa.binary()}
    for batch in batches:
        for i in range(0, batch.num_rows, 200):
            rows = []
            for ident, lang, at, words, places in zip(*(batch.slice(i, 200).column(c).to_pylist() for c in ("ident", "lang", "at", "words", "places"))):
                runs = Runs(at, words, lang)
                p, need = (np.array([x[c] for x in places], np.int64) for c in ("p", "need"))
                high = np.minimum(last_of_run(runs.at)[np.searchsorted(runs.at, p)], p + need)
                rows += [(x["key"], ident, follow) for x, follow in zip(places, runs.follows(p, high + LONG))]
            yield table(rows, kinds)


def common(a, b):
    """Words in common at the start of two strings of eight bytes a word."""
    low, high = 0, min(len(a), len(b)) // 8
    while low < high:
        mid = (low + high + 1) // 2
        if a[low * 8 : mid * 8] == b[low * 8 : mid * 8]:
            low = mid
        else:
            high = mid - 1
    return low


def longest(follow, me, offers):
    """Words of the longest match of `follow` with offers, sorted rows (follow, smallest, largest document), of another document than me."""
    best, at = 0, bisect.bisect_left(offers, (follow,))
    for places in (range(at - 1, -1, -1), range(at, len(offers))):
        for i in places:
            if offers[i][1] != me or offers[i][2] != me:
                best = max(best, common(follow, offers[i][0]))
                break
    return best


def _matcher(batches):
    """Lengths of matches: rows (row, p, length) from offers (kind 0) and questions (kind 1) sorted by key and kind."""
    key, offers, ready = None, [], False
    kinds = {"row": pa.int64(), "p": pa.int32(), "length": pa.int32()}
    for batch in batches:
        rows = []
        for k, kind, row, p, ident, high, follow in zip(*(batch.column(c).to_pylist() for c in ("key", "kind", "row", "p", "ident", "high", "follow"))):
            if k != key:
                key, offers, ready = k, [], False
            if not kind:
                offers.append((follow, ident, high))
                continue
            if not ready:
                offers.sort()
                ready = True
            rows.append((row, p, LONG + longest(follow, ident, offers)))
        yield table(rows, kinds)


def _spanner(batches):
    """Rows (row, ident, sizes, words): stretches of a source that cover its places with the same eight words as the open document `open`."""
    kinds = {"row": pa.int64(), "ident": pa.int64(), "sizes": pa.binary(), "words": pa.binary()}
    for batch in batches:
        for i in range(0, batch.num_rows, 500):
            rows = []
            for row, ident, lang, at, words, places in zip(*(batch.slice(i, 500).column(c).to_pylist() for c in ("open", "ident", "lang", "at", "words", "places"))):
                runs, p = Runs(at, words, lang), np.sort(np.array(places, np.int64))
                new = np.flatnonzero(np.concatenate(([True], np.diff(p) > LONG)))
                sizes = p[np.concatenate((new[1:] - 1, [len(p) - 1]))] + LONG - p[new]
                parts = [runs.words[a : a + n] for a, n in zip(runs.offset(p[new]).tolist(), sizes.tolist())]
                rows.append((row, ident, sizes.astype("<i4").tobytes(), np.concatenate(parts).astype("<u8").tobytes()))
            yield table(rows, kinds)


class Lengths(dict):
    """Lengths of a document's matches by place, found where they are asked for; others are (sizes, words) of stretches with eight words in common."""

    def __init__(self, runs, ends, others):
        self.runs, self.ends, lang = runs, ends, salt(runs.lang)
        sizes = np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(x, "<i4").astype(np.int64) for x, _ in others)])
        self.words = np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(x, "<u8") for _, x in others)])
        left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(self.words))  # words to the stretch's end
        at = np.flatnonzero(left >= LONG)
        keys = grams(self.words, np.full(len(at), lang), at, LONG).view(np.int64)
        order = np.argsort(keys)
        self.keys, self.at, self.left = keys[order], at[order], left[at[order]]

    def __contains__(self, p):
        return True

    def __missing__(self, p):
        key, most = self.runs.keys([p])[0], int(self.ends[p]) + LONG - p
        a, b = np.searchsorted(self.keys, key), np.searchsorted(self.keys, key, side="right")
        at, left, mine = self.at[a:b], np.minimum(self.left[a:b], most), int(self.runs.offset(p))
        mine, best, done, step = self.runs.words[mine : mine + most], LONG, LONG, 16
        while len(at):  # those that agree so far
            step = max(16, min(2 * step, (1 << 20) // len(at)))
            n = np.arange(done, min(done + step, most))
            same = (self.words[np.minimum(at[:, None] + n, len(self.words) - 1)] == mine[n]) & (n < left[:, None])
            whole = same.all(axis=1)
            best = max(best, done + int(np.where(whole, len(n), same.argmin(axis=1)).max(initial=0)) if len(n) else best)
            done += len(n)
            at, left = at[whole & (left > done)], left[whole & (left > done)]
        self[p] = best
        return best


def _finisher(batches):
    """Rows (row, found): phrases of open documents (kind 1), each after the stretches of others (kind 0)."""
    held, others = None, []
    for batch in batches:
        for i in range(0, batch.num_rows, 500):
            rows = []
            for kind, row, ident, lang, match, at, words, sizes in zip(*(batch.slice(i, 500).column(c).to_pylist() for c in ("kind", "row", "ident", "lang", "match", "at", "words", "sizes"))):
                if row != held:
                    held, others = row, []
                if not kind:
                    others.append((ident, sizes, words))
                    continue
                match = np.frombuffer(match, np.uint8)
                ends = run_ends(match)
                lengths = Lengths(Runs(at, words, lang), ends, [x for other, *x in others if other != ident])
                rows.append((row, parse(match, ends, lengths, 0)[0]))
                others = []
            yield table(rows, {"row": pa.int64(), "found": pa.int64()})


def few(df):
    return df.limit(FEW + 1).count() <= FEW


def only(df, rows):
    """The rows of df whose numbers `rows` has, where those are so few that df needn't move for it; else df."""
    return df.join(F.broadcast(rows.select("row")), "row", "left_semi") if few(rows) else df


def narrowed(spark, offers, sources, todo):
    """The offers whose keys the documents in todo have in their runs, the others are never asked for again, and their sources."""
    keys = todo.select("row", "lang", "at", "words").mapInArrow(_offerer, OFFER).select("key").distinct()
    offers = stored(spark, offers.join(beside(spark, keys, "keys"), "key", "left_semi").select("key", "row", "p"), "offers")
    rows = beside(spark, offers.select("row").distinct(), "rows")
    return offers, stored(spark, sources.join(rows, "row", "left_semi").select(*sources.columns), "sources")


def finished(spark, offers, sources, todo):
    """Rows (row, found) of all open documents, each parsed beside the words of others that match eight of its own; None where those are more than PAIRS."""
    keys = stored(spark, todo.select("row", "lang", "at", "words").mapInArrow(_offerer, OFFER).select(F.col("row").alias("open"), "key").distinct(), "keys")
    times = beside(spark, keys.groupBy("key").agg(F.count(F.lit(1)).alias("times")), "times")
    if (offers.join(times, "key").agg(F.sum("times")).first()[0] or 0) > PAIRS:
        return None
    places = offers.join(keys, "key").where("row <> open").groupBy("open", "row").agg(F.collect_list("p").alias("places"))
    places = stored(spark, places, "places")
    others = only(sources, places).join(places, "row").mapInArrow(_spanner, "row long, ident long, sizes binary, words binary")
    both = todo.withColumn("kind", F.lit(1)).unionByName(others.withColumn("kind", F.lit(0)), allowMissingColumns=True)
    return stored(spark, both.repartition("row").sortWithinPartitions("row", "kind").mapInArrow(_finisher, "row long, found long"), "finished")


def whole_parse_scores(spark, docs, good):
    """Score of every document of docs(doc_id, text, lang) against all documents of its language whose ids are in good(doc_id).

    Rows (doc_id, n_words, n_phrases, n_reference, cross_bits, own_bits, score); n_reference is the words of the language's reference.
    """
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit("\u0000")).alias("lang"))
    marks = good.where("doc_id is not null").select("doc_id").distinct()
    some = marks.join(d.where("trim(text) <> ''").select("doc_id"), "doc_id", "left_semi").limit(1).count()
    repeated = d.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1 or doc_id is null").select(F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("doc_id").isNull().alias("none"))
    repeated = beside(spark, repeated, "repeated")
    d = d.join(beside(spark, marks.withColumn("good", F.lit(True)), "marks"), "doc_id", "left").withColumn("good", F.coalesce("good", F.lit(False))) if some else d.withColumn("good", F.lit(True))
    d = d.withColumn("id", F.coalesce("doc_id", F.lit(0))).withColumn("none", F.col("doc_id").isNull()).join(repeated.withColumn("odd", F.xxhash64("id", "none").bitwiseOR(F.lit(-(1 << 63)))), ["id", "none"], "left")
    path = f"{shared_dir(spark)}/words-{hashlib.blake2b(np.random.bytes(16), digest_size=12).hexdigest()}"
    d.mapInArrow(_texter, schema(CHUNK_ROW)).write.option("compression", "none").parquet(path)
    texts = spark.read.schema(schema(CHUNK_ROW)).parquet(path).withColumn("kind", F.lit(1))
    words = texts.agg(F.sum("words")).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-words // BUCKET))
    settle(spark)

    def chunks(*replies):
        rows = texts
        if not replies:
            return rows
        for r in replies:
            rows = rows.unionByName(r.withColumn("kind", F.lit(0)), allowMissingColumns=True)
        return rows.repartition("chunk").sortWithinPartitions("chunk", "kind", "k")

    replies, before = [], None
    for levels in LEVELS:
        last = [r.where(F.col("k") == before) for r in replies[-1:]]
        sent = chunks(*last).mapInArrow(_sender(levels, before, buckets), schema(MESSAGE))
        replies.append(stored(spark, sent.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(_resolver, schema(REPLY)), "replies"))
        before = levels[-1]
        del sent, last
        for _ in range(2):  # what the first finds still in use goes with the second, before the next files come
            settle(spark)
            time.sleep(0.5)
    parsed = stored(spark, chunks(*replies).mapInArrow(_documents, schema(DOC)), "parsed")
    for x in (texts, *replies):
        drop_stored(spark, x)
    for _ in range(2):
        settle(spark)
        time.sleep(0.5)
    sources = parsed.where("good and at is not null").select("row", "ident", "lang", "at", "words")
    offers = stored(spark, sources.mapInArrow(_offerer, OFFER), "offers")
    held = offers.count()
    todo, known, done, ahead = parsed.where("phrases is null").select("row", "lang", "ident", "match", "at", "words"), None, None, 0
    while True:
        if known is None:
            ask = todo.withColumn("known", F.lit(None).cast("array<struct<p:int,length:int>>"))
        else:  # only what is known of documents still open, beside them where that is little
            lengths = only(known, rows).groupBy("row").agg(F.collect_list(F.struct("p", "length")).alias("known"))
            ask = todo.join(F.broadcast(lengths) if known.count() <= 500_000 else lengths, "row", "left")
        asked = stored(spark, ask.mapInArrow(_asker(ahead), schema(ASK)), "asked")
        ended, open_ = asked.where("phrases is not null").select("row", F.col("phrases").alias("found")), asked.where("phrases is null")
        done = ended if done is None else done.unionAll(ended)
        if not open_.limit(1).count():
            break
        need = beside(spark, open_.groupBy("key").agg(F.max(F.expr("length(follow) / 8")).cast("int").alias("need")), "need")
        places = stored(spark, offers.join(need, "key").groupBy("row").agg(F.collect_list(F.struct("key", "p", "need")).alias("places")), "places")
        offered = only(sources, places).join(places, "row").mapInArrow(_follower, "key long, ident long, follow binary").groupBy("key", "follow").agg(F.min("ident").alias("ident"), F.max("ident").alias("high"))
        both = offered.withColumn("kind", F.lit(0)).unionByName(open_.drop("phrases").withColumn("kind", F.lit(1)), allowMissingColumns=True)
        new = stored(spark, both.repartition("key").sortWithinPartitions("key", "kind").mapInArrow(_matcher, "row long, p int, length int"), "lengths")
        rows = stored(spark, open_.select("row").distinct(), "rows")
        if known is not None:  # at first all of them are open
            todo = stored(spark, only(todo, rows) if few(rows) else todo.join(rows, "row", "left_semi"), "todo")
        known, ahead = new if known is None else known.unionAll(new), 16 * ahead or 16
        del need, places, offered, both, ask
        size = todo.agg(F.sum(F.expr("length(at) div 4"))).first()[0] or 0
        if 8 * size <= held:
            offers, sources = narrowed(spark, offers, sources, todo)
            held = offers.count()
        settle(spark)
        rest = finished(spark, offers, sources, todo) if 8 * size <= PAIRS else None
        if rest is not None:
            done = done.unionAll(rest)
            break
    reference = beside(spark, parsed.where("good").groupBy("lang").agg(F.sum("n").alias("m")), "reference")
    bits = lambda n, m: F.col(n) * F.log2(F.greatest(F.col(m), F.lit(2)).cast("double"))
    out = parsed.select("row", "doc_id", "lang", "n", "own", "phrases").join(done, "row", "left").join(reference, "lang", "left")
    out = out.select("doc_id", F.col("n").alias("n_words"), F.coalesce("phrases", "found").alias("n_phrases"), F.coalesce("m", F.lit(0)).alias("n_reference"), "own")
    words = F.col("n_words") > 0
    out = out.withColumn("cross_bits", F.when(words, bits("n_phrases", "n_reference") / F.col("n_words"))).withColumn("own_bits", F.when(words, F.when(F.col("own") > 1, bits("own", "own")).otherwise(0.0) / F.col("n_words")))
    return out.select("doc_id", "n_words", "n_phrases", "n_reference", "cross_bits", "own_bits", (F.col("cross_bits") - F.col("own_bits")).alias("score"))
