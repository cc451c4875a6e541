"""Language-model scores by Ziv-Merhav cross-parsing.

A document is cut greedily into the longest phrases that occur in a reference text; few, long phrases mean that the
reference predicts it well.  The longest match at each step comes from a suffix automaton over the reference's words.
With c phrases for n words and a reference of m words the cross term is c * log2(m) / n bits a word; less the document's
own incremental-parsing term it estimates the relative entropy between document and reference.

The reference is every document labelled as good (or every document where there are no such labels), so it grows with
the corpus; a document is never its own reference.  An automaton of all of it fits no task and parsing every document
against every part of it takes time that grows with the square of the corpus.  So documents and reference are cut into
segments of 16 to 256 words where the hash of the next five words says so, which cuts copies of a passage at the same places.
The smallest hash of a segment's five-word shingles names its shard of about `shard_words` words of reference in its
language, and a segment is parsed against the shard of its own content: copied passages of a few segments meet
their copies wherever in the reference they are, and what is left meets about `shard_words` words like any other.
Phrases end with their segment.  Short matches that only other shards hold are missed, and the m of the cross term is the
shard's, as the estimate asks (README has the measured difference to a parse against everything).

A content that copies make larger than some shards is cut by hash of doc_id into shards of its own; segments of a
shard are split into runs of about `run_words` words, each with its own copy of the shard's text, so neither a hot shard
nor a small reference makes one long task.  Rows stream through sorted partitions: a task holds one automaton and one segment.

Defined cases: null and empty texts have no words, no phrases and null scores; a word that the reference lacks is a phrase
of its own; a language without reference gives one phrase a word; a null language counts as a language; rows that share a
doc_id aren't references of each other (rows without doc_id count as one document); repeated rows are scored alike; extra
columns are ignored; an empty table gives an empty result.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ._store import beside, stored
from ._text import powers, shingles, small_batches, span_hashes, string_buffers, word_spans

NO_ID = -(1 << 63)


class Automaton:
    """Suffix automaton over word sequences of documents; phrases don't run across sequences.

    Every state knows the first and last document, by number, that holds its words, so a parse can leave one out.
    """

    def __init__(self):
        self.next, self.link, self.length, self.low, self.high, self.words, self.ready = [{}], [-1], [0], [1 << 63], [-(1 << 63)], 0, True

    def add(self, words, doc=0):
        nxt, link, length, last = self.next, self.link, self.length, 0
        low, high = self.low, self.high
        self.words += len(words)
        self.ready = False
        for w in words:
            q = nxt[last].get(w)
            if q is not None:  # known context: the state may need a clone
                if length[q] != length[last] + 1:
                    q = self._clone(last, w, q)
                last = q
            else:
                cur = len(nxt)
                nxt.append({})
                length.append(length[last] + 1)
                link.append(0)
                low.append(doc)
                high.append(doc)
                p = last
                while p >= 0 and w not in nxt[p]:
                    nxt[p][w] = cur
                    p = link[p]
                if p >= 0:
                    q = nxt[p][w]
                    link[cur] = q if length[q] == length[p] + 1 else self._clone(p, w, q)
                last = cur
            if doc < low[last]:
                low[last] = doc
            if doc > high[last]:
                high[last] = doc

    def finish(self):
        """Hand the documents of every state on to its shorter suffixes."""
        low, high, link = self.low, self.high, self.link
        for s in sorted(range(1, len(link)), key=self.length.__getitem__, reverse=True):
            p = link[s]
            if low[s] < low[p]:
                low[p] = low[s]
            if high[s] > high[p]:
                high[p] = high[s]
        self.ready = True

    def _clone(self, p, w, q):
        nxt, link, length = self.next, self.link, self.length
        c = len(nxt)
        nxt.append(dict(nxt[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        self.low.append(self.low[q])
        self.high.append(self.high[q])
        while p >= 0 and nxt[p].get(w) == q:
            nxt[p][w] = c
            p = link[p]
        link[q] = c
        return c

    def phrases(self, words, own=None):
        """Number of phrases of the greedy longest-match parse against all documents but `own`."""
        if not self.ready:
            self.finish()
        nxt, root, low, high, s, c = self.next, self.next[0], self.low, self.high, 0, 0
        for w in words:
            t = nxt[s].get(w)
            if t is None or low[t] == own and high[t] == own:
                if s:
                    c += 1
                t = root.get(w)
                if t is None or low[t] == own and high[t] == own:
                    c += 1
                    t = 0
            s = t
        return c + (s != 0)


def own_phrases(words):
    """Number of phrases of the incremental (dictionary) parse of a sequence by itself."""
    root, c = {}, 0
    node = root
    for w in words:
        if w in node:
            after = node[w]
            if after is None:  # a phrase of its own so far
                after = node[w] = {}
            node = after
        else:
            c += 1
            node[w] = None
            node = root
    return c + (node is not root)


def words_of(text):
    return (text or "").lower().split()


def cuts(hashes, valid, first, mark=64, least=16, most=256):
    """Per document the word positions where segments start: at marked hashes, with least to most words between."""
    at = np.flatnonzero((hashes % np.uint64(mark) == 0) & valid)
    edges = np.searchsorted(at, first)
    for d in range(len(first) - 1):
        a, b = int(first[d]), int(first[d + 1])
        out, last = [a], a
        for x in at[edges[d] : edges[d + 1]].tolist():
            while x - last > most:
                last += most
                out.append(last)
            if x - last >= least and b - x >= least:
                out.append(x)
                last = x
        while b - last > most:
            last += most
            out.append(last)
        yield out


def segments(texts, pows=None):
    """Per text of an Arrow string array its segments (text, number of words, content); one empty segment without words."""
    data, offs = string_buffers(texts)
    s, e, first = word_spans(data, offs)
    words = span_hashes(data, s, e, pows=pows)
    h, valid = shingles(words, first, 5)
    for d, starts in enumerate(cuts(h, valid, first)):
        end = int(first[d + 1])
        if starts[0] >= end:
            yield [("", 0, 0)]
            continue
        out = []
        for a, b in zip(starts, [*starts[1:], end]):
            inside = h[a : b - 4] if b - a >= 5 else h[a : a + 1] if valid[a] else words[a:b]
            out.append((data[s[a] : e[b - 1]].tobytes().decode("utf-8", "replace"), b - a, int(inside.min()) >> 1))
        yield out


def _measurer(batches):
    """Rows (doc_id, lang, content, size) of all segments."""
    pows = powers(1 << 21)
    for batch in small_batches(batches):
        rows = [(i, lang, content, n) for i, lang, parts in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "lang")), segments(batch.column("text"), pows)) for _, n, content in parts if n]
        cols = list(zip(*rows)) if rows else [[]] * 4
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, kinds)], names=["doc_id", "lang", "content", "size"])


def _segmenter(batches):
    """Rows (row, doc_id, lang, good, content, size, text, own): own is the document's own phrases, on its first segment."""
    from pyspark import TaskContext

    row, pows = TaskContext.get().partitionId() << 40, powers(1 << 21)
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.int64(), pa.int64(), pa.string(), pa.int64()]
    names = ["row", "doc_id", "lang", "good", "content", "size", "text", "own"]
    for batch in small_batches(batches):
        rows = []
        for i, lang, good, text, parts in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "lang", "good", "text")), segments(batch.column("text"), pows)):
            row += 1
            own = own_phrases(words_of(text))
            for k, (part, n, content) in enumerate(parts):
                rows.append((row, i, lang, good, content if n else row, n, part, own if k == 0 else None))
        cols = list(zip(*rows)) if rows else [[]] * 8
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, kinds)], names=names)


def _scorer(batches):
    """Per segment its phrases and the reference's words: rows (row, doc_id, own, words, phrases, reference)."""
    key, automaton = None, Automaton()
    for batch in batches:
        for at in range(0, batch.num_rows, 5000):
            rows, part = [], batch.slice(at, 5000)
            for k, document, row, doc_id, own, text in zip(*(part.column(c).to_pylist() for c in ("key", "document", "row", "doc_id", "own", "text"))):
                if k != key:
                    key, automaton = k, Automaton()
                words, me = words_of(text), NO_ID if doc_id is None else doc_id
                if document:
                    rows.append((row, doc_id, own, len(words), automaton.phrases(words, me), automaton.words))
                else:
                    automaton.add(words, me)
            cols = list(zip(*rows)) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in cols], names=["row", "doc_id", "own", "words", "phrases", "reference"])


def cross_parse_scores(spark, docs, good, shard_words=100_000, run_words=1_000_000):
    """Score of every document of docs(doc_id, text, lang) against the documents whose ids are in good(doc_id).

    Rows (doc_id, n_words, n_phrases, n_reference, cross_bits, own_bits, score); n_reference is the largest of the references
    that the document's segments met.
    """
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit("\u0000")).alias("lang"))
    marks = good.where("doc_id is not null").select("doc_id").distinct()
    some = marks.join(d.where("trim(text) <> ''").select("doc_id"), "doc_id", "left_semi").limit(1).count()
    marked = lambda x: x.join(marks.withColumn("good", F.lit(True)).hint("merge"), "doc_id", "left").withColumn("good", F.coalesce("good", F.lit(False))) if some else x.withColumn("good", F.lit(True))
    sizes = stored(spark, marked(d.mapInArrow(_measurer, "doc_id long, lang string, content long, size long")), "sizes")
    reference = F.sum(F.when(F.col("good"), F.col("size")).otherwise(0))
    langs = beside(spark, sizes.groupBy("lang").agg(F.greatest(F.lit(1), F.ceil(reference / shard_words)).cast("long").alias("shards")), "langs")
    hot = beside(spark, sizes.groupBy("lang", "content").agg(F.ceil(reference / (4 * shard_words)).cast("long").alias("pieces")).where("pieces > 1"), "hot")

    def routed(x):
        x = x.join(langs, "lang", "left").join(hot, ["lang", "content"], "left").withColumn("apart", F.col("pieces").isNotNull())
        own = F.xxhash64("content", F.pmod(F.xxhash64("doc_id"), "pieces"))
        return x.withColumn("shard", F.when(F.col("apart"), own).otherwise(F.pmod("content", F.coalesce("shards", F.lit(1)))))

    load = beside(spark, routed(sizes).groupBy("lang", "apart", "shard").agg(F.greatest(F.lit(1), F.ceil(F.sum("size") / run_words)).cast("int").alias("runs")), "load")
    cut = marked(d).mapInArrow(_segmenter, "row long, doc_id long, lang string, good boolean, content long, size long, text string, own long")
    routes = routed(cut).join(load, ["lang", "apart", "shard"], "left").withColumn("runs", F.coalesce("runs", F.lit(1)))
    row = lambda run, document: F.struct(run.cast("int").alias("run"), F.lit(document).alias("document"))
    copies = F.transform(F.sequence(F.lit(0), F.col("runs") - 1), lambda r: row(r, 0))
    none = F.array().cast("array<struct<run:int,document:int>>")
    mine = row(F.pmod(F.xxhash64("row"), F.col("runs").cast("long")), 1)
    rows = routes.select("row", "doc_id", "own", "text", "lang", "apart", "shard", F.explode(F.concat(F.array(mine), F.when(F.col("good"), copies).otherwise(none))).alias("x"))
    rows = rows.select(F.xxhash64("lang", "apart", "shard", "x.run").alias("key"), "x.document", "row", "doc_id", "own", "text")
    parts = rows.repartition("key").sortWithinPartitions("key", "document", "doc_id").mapInArrow(_scorer, "row long, doc_id long, own long, words long, phrases long, reference long")
    bits = lambda n, m: F.col(n) * F.log2(F.greatest(F.col(m), F.lit(2)).cast("double"))
    done = parts.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.sum("words").alias("n_words"), F.sum("phrases").alias("n_phrases"), F.max("reference").alias("n_reference"), F.sum(bits("phrases", "reference")).alias("cross"), F.max("own").alias("own"))
    some = F.col("n_words") > 0
    done = done.withColumn("cross_bits", F.when(some, F.col("cross") / F.col("n_words"))).withColumn("own_bits", F.when(some, F.when(F.col("own") > 1, bits("own", "own")).otherwise(0.0) / F.col("n_words")))
    return done.select("doc_id", "n_words", "n_phrases", "n_reference", "cross_bits", "own_bits", (F.col("cross_bits") - F.col("own_bits")).alias("score"))
