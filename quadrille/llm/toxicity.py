"""Toxic span tagging with a two-state linear-chain conditional random field.

Labels exist per document only, so token labels are derived first: in a toxic training document those tokens whose word
or affix occurs far more often in toxic than in clean training documents are labelled 1, all other tokens 0.  The field
(hashed word and affix weights, 2 x 2 transitions) is fitted on those tokens; forward-backward marginals then tag every
token of every document.  A logistic layer over the summed, highest and mean marginal of a document gives its score.

Fitting uses a bounded sample of labelled rows, at most `per_class` documents of each label, chosen by hash of doc_id.
Scoring covers every token of every text.

Defined cases: null and empty texts, and texts without a word, get the score of a document with no toxic token; null
doc_ids are scored like others; without any training label of both kinds every score is the share of toxic labels (0
without labels); unlabelled and null labels are not learnt from; repeated labels of a document count as toxic if one
does; extra columns are ignored.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from ._text import mix, powers, shingles, small_batches, span_hasher, span_hashes, string_buffers

BITS = 18
_OUT = "doc_id long, score double, spans array<struct<start:long,end:long,score:double>>"


def folded(data):
    """The bytes with the two-byte capitals U+00C0 to U+00DE as small letters; A-Z fold in the hash."""
    out = data.copy()
    high = np.flatnonzero((out[1:] >= 0x80) & (out[1:] <= 0x9E) & (out[:-1] == 0xC3)) + 1
    out[high] += 0x20
    return out


def token_spans(data, offs):
    """Start and end byte of each run of letters and digits (any byte from 0x80 counts as a letter); first token per document."""
    inside = np.zeros(256, dtype=bool)
    inside[48:58] = inside[65:91] = inside[97:123] = inside[128:] = True
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    word = inside[data]
    start, end = word.copy(), word.copy()
    start[1:] &= ~word[:-1]
    end[:-1] &= ~word[1:]
    inner = offs[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    start[inner] = word[inner]
    end[inner - 1] = word[inner - 1]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    return s, e, np.searchsorted(s, offs)


def token_features(data, s, e, pows=None):
    """Bucket of the word, of its first 3, 4 and 5 bytes and of its last 4 bytes, for each token: an array (tokens, 5)."""
    out = np.empty((len(s), 5), dtype=np.int32)
    if not len(s):
        return out
    cuts = [(s, e), (s, np.minimum(s + 3, e)), (s, np.minimum(s + 4, e)), (s, np.minimum(s + 5, e)), (np.maximum(e - 4, s), e)]
    hashes = span_hasher(data, pows=pows)
    for k, (a, b) in enumerate(cuts):
        out[:, k] = (mix(hashes(a, b) + np.uint64(k)) >> np.uint64(64 - BITS)).astype(np.int32)
    return out


def running_products(m, lanes):
    """Running products of a stream of 2 x 2 matrices m (2, 2, n), each scaled to sum 1, as vectors: v[t] = (1, 1) m[0] ... m[t].

    The stream is cut into lanes of equal length; all lanes advance together, then each is entered with the vector that
    the lanes before it leave.
    """
    n = m.shape[2]
    steps = -(-n // lanes)
    p = np.zeros((steps * lanes, 2, 2))
    p[:, 0, 0] = p[:, 1, 1] = 1
    p[:n] = m.transpose(2, 0, 1)
    p = np.ascontiguousarray(p.reshape(lanes, steps, 2, 2).transpose(1, 2, 3, 0))
    for t in range(1, steps):
        x, y = p[t - 1], p[t]
        z = x[:, :1] * y[0]
        z += x[:, 1:] * y[1]
        z /= z.sum(axis=(0, 1))
        p[t] = z
    enter, v0, v1 = np.empty((2, lanes)), 0.5, 0.5
    for k, (a, b, c, d) in enumerate(zip(*(p[-1, i, j].tolist() for i in (0, 1) for j in (0, 1)))):
        enter[0, k], enter[1, k] = v0, v1
        v0, v1 = v0 * a + v1 * c, v0 * b + v1 * d
        s = v0 + v1
        v0, v1 = v0 / s, v1 / s
    out = p[:, 0] * enter[0]
    out += p[:, 1] * enter[1]  # (steps, 2, lanes)
    return out.transpose(1, 2, 0).reshape(2, -1)[:, :n]


def marginals(emit, first, trans, start):
    """P(tag 1) per token by forward-backward, exact for any length.

    emit is the log-odds of tag 1 per token, first the index of each document's first token (and the end).  A document's
    first matrix has equal rows, so nothing is carried over from the document before.
    """
    n = len(emit)
    if not n:
        return np.zeros(0)
    psi = np.clip(emit, -60, 60)
    w = np.stack([np.exp(np.minimum(-psi, 0)), np.exp(np.minimum(psi, 0))])
    m = np.exp(trans - trans.max())[:, :, None] * w[None]
    heads = first[:-1][np.diff(first) > 0]
    p1 = np.exp(start[1] - np.logaddexp(start[0], start[1]))
    m[:, :, heads] = np.array([1 - p1, p1])[None, :, None] * w[:, heads][None]
    lanes = max(1, int(np.sqrt(n)))
    alpha = running_products(m, lanes)
    # beta[t] = m[t+1] ... m[end] (1, 1): the same products over the transposed matrices from the end
    back = np.empty_like(m)
    back[:, :, 1:] = m[:, :, :0:-1].transpose(1, 0, 2)
    back[:, :, 0] = 0.5
    beta = running_products(back, lanes)[:, ::-1]
    one, zero = alpha[1] * beta[1], alpha[0] * beta[0]
    return one / np.maximum(one + zero, 1e-300)


def document_features(m, first):
    """Per document log(1 + sum), maximum and mean of its marginals; zeros without tokens."""
    counts = np.diff(first)
    out = np.zeros((len(counts), 3))
    full = np.flatnonzero(counts)
    if len(full):
        at = first[full]
        total = np.add.reduceat(m, at)
        out[full, 0], out[full, 1], out[full, 2] = np.log1p(total), np.maximum.reduceat(m, at), total / counts[full]
    return out


def _pairwise(first, trans, m):
    """Expected transition counts (2 x 2) and starts under the field, from forward messages and marginals."""
    counts = np.diff(first)
    heads = first[:-1][counts > 0]
    follow = np.ones(len(m), dtype=bool)
    follow[heads] = False
    at = np.flatnonzero(follow)
    # P(y[t-1], y[t]) from the marginals at t-1 and t and the cross ratio that pairwise potentials fix
    ratio = np.exp(trans[0, 0] + trans[1, 1] - trans[0, 1] - trans[1, 0])
    a, b = m[at - 1], m[at]
    if abs(ratio - 1) < 1e-9:
        both = a * b
    else:
        s = 1 + (a + b) * (ratio - 1)
        both = (s - np.sqrt(np.maximum(s * s - 4 * ratio * (ratio - 1) * a * b, 0))) / (2 * (ratio - 1))
    p11, p10, p01 = both.sum(), (a - both).sum(), (b - both).sum()
    return np.array([[len(at) - p11 - p10 - p01, p01], [p10, p11]]), np.array([len(heads) - m[heads].sum(), m[heads].sum()])


def association(pos, neg, n_pos, n_neg):
    """Per bucket the log-likelihood ratio statistic of its document counts, negative where clean documents have it more often."""
    share = n_pos / (n_pos + n_neg)
    total = pos + neg
    with np.errstate(divide="ignore", invalid="ignore"):
        g = np.where(pos > 0, pos * np.log(pos / (total * share)), 0.0) + np.where(neg > 0, neg * np.log(neg / (total * (1 - share))), 0.0)
    return np.where(pos > total * share, 2 * g, -2 * g)


def fit(texts, toxic, prior=None, rounds=30, rate=0.4, ridge=1e-4, sure=27.0, windows=4000, window=100):
    """A model from Arrow texts and 0/1 labels: weights by bucket, transitions, start and the document layer.

    Of near copies (equal smallest shingle) one text is learnt from.  Token labels are words or affixes whose
    association with toxic documents passes `sure` (27 is the 5 % level over all 2**18 buckets); chains of `window`
    tokens are fitted, up to `windows` of them.
    prior is the share of toxic documents where the texts were drawn by class.
    """
    toxic = np.asarray(toxic, dtype=np.int64)
    base = float(toxic.mean()) if len(toxic) else 0.0
    model = {"w": np.zeros(1 << BITS, np.float32), "bias": -6.0, "trans": np.zeros((2, 2)), "start": np.zeros(2), "doc": np.zeros(4), "base": base}
    if not len(toxic) or base in (0.0, 1.0):
        return model
    xs_, counts, lowest = [], [], []
    for part in small_batches([pa.RecordBatch.from_arrays([texts], names=["text"])]):  # bounded working memory
        data, offs = string_buffers(part.column(0))
        data = folded(data)
        s, e, f = token_spans(data, offs)
        grams, valid = shingles(span_hashes(data, s, e), f, 4)
        grams[~valid] = np.uint64(2**64 - 1)
        c = np.diff(f)
        low = mix(np.arange(len(c), dtype=np.uint64) + np.uint64(sum(map(len, counts))))
        full = np.flatnonzero(c)
        if len(full):
            low[full] = np.minimum.reduceat(grams, f[full])
        xs_.append(token_features(data, s, e))
        counts.append(c)
        lowest.append(low)
    x, counts = np.concatenate(xs_), np.concatenate(counts)
    del xs_
    first = np.concatenate(([0], np.cumsum(counts)))
    own = np.zeros(len(toxic), dtype=bool)
    own[np.unique(np.concatenate(lowest), return_index=True)[1]] = True
    doc = np.repeat(np.arange(len(toxic), dtype=np.int32), counts)
    bucket_docs = [np.zeros(1 << BITS), np.zeros(1 << BITS)]
    for k in range(x.shape[1]):
        pairs = np.unique((doc.astype(np.int64) << BITS) | x[:, k])
        pairs = pairs[own[pairs >> BITS]]
        for v in (0, 1):
            bucket_docs[v] += np.bincount((pairs & ((1 << BITS) - 1))[toxic[pairs >> BITS] == v], minlength=1 << BITS)
    g2 = association(bucket_docs[1], bucket_docs[0], max(1, (toxic[own] == 1).sum()), max(1, (toxic[own] == 0).sum())).astype(np.float32)
    active = np.abs(g2) >= sure / 2
    best = g2[x[:, 0]]
    for k in range(1, x.shape[1]):
        np.maximum(best, g2[x[:, k]], out=best)
    y = ((toxic[doc] == 1) & (best >= sure)).astype(np.float32)
    del doc, best
    # a bounded set of training chains, half of them with labelled tokens where there are so many
    heads = np.concatenate([np.zeros(0, np.int64), *(np.arange(a, b, window) for a, b, o in zip(first[:-1], first[1:], own) if o)])
    ends = np.minimum(heads + window, first[np.searchsorted(first, heads, side="right")])
    order = np.argsort(mix(heads.astype(np.uint64)), kind="stable")
    summed = np.concatenate(([0], np.cumsum(y, dtype=np.int64)))
    marked = (summed[ends] - summed[heads] > 0)[order]
    some = order[marked][: windows // 2]
    chosen = np.sort(np.concatenate([some, order[~marked][: windows - len(some)]]))
    cut = np.concatenate(([0], np.cumsum(ends[chosen] - heads[chosen]))).astype(np.int64)
    at = np.repeat(heads[chosen] - cut[:-1], np.diff(cut)) + np.arange(cut[-1])
    xs, ys = x[at], y[at].astype(np.float64)
    flat = xs.reshape(-1)
    seen_t, seen_s = _pairwise_counts(ys, cut)
    w, bias, trans, start = np.zeros(1 << BITS), -4.0, np.zeros((2, 2)), np.zeros(2)
    scale = active / np.sqrt(np.bincount(flat, minlength=1 << BITS) + 1.0)
    grad2, n = np.full(1 << BITS, 1e-8), max(1, len(ys))
    for _ in range(rounds):
        m = marginals(w[xs].sum(axis=1) + bias, cut, trans, start)
        r = ys - m
        g = np.bincount(flat, weights=np.repeat(r, xs.shape[1]), minlength=1 << BITS) * scale - ridge * w
        grad2 += g * g
        w += rate * g / np.sqrt(grad2)
        bias = float(np.clip(bias + 4 * r.sum() / np.sqrt(n * (ys.sum() + 1)), -8, 4))
        exp_t, exp_s = _pairwise(cut, trans, m)
        trans = np.clip(trans + 2 * (seen_t - exp_t) / n, -3, 3)
        start = np.clip(start + 2 * (seen_s - exp_s) / max(1, len(cut) - 1), -3, 3)
    model |= {"w": w.astype(np.float32), "bias": bias, "trans": trans, "start": start}
    z = np.zeros((len(toxic), 3))
    for a in range(0, len(toxic), 100):
        f = first[a : a + 101]
        z[a : a + 100] = document_features(marginals(model["w"][x[f[0] : f[-1]]].sum(axis=1, dtype=np.float64) + bias, f - f[0], trans, start), f - f[0])
    z1, v = np.hstack([z, np.ones((len(z), 1))]), np.zeros(4)
    prior = base if prior is None else prior
    weight = np.where(toxic == 1, prior / base, (1 - prior) / (1 - base)) * own
    for _ in range(25):  # Newton steps with a small ridge
        p = 1 / (1 + np.exp(-np.clip(z1 @ v, -40, 40)))
        h = (z1 * (weight * p * (1 - p))[:, None]).T @ z1 + 0.05 * np.eye(4)
        v += np.clip(np.linalg.solve(h, z1.T @ (weight * (toxic - p)) - 0.05 * v), -5, 5)
    model["doc"] = v
    return model


def _pairwise_counts(y, cut):
    heads = cut[:-1][np.diff(cut) > 0]
    follow = np.ones(len(y), dtype=bool)
    follow[heads] = False
    at = np.flatnonzero(follow)
    a, b = y[at - 1], y[at]
    p11 = (a * b).sum()
    return np.array([[len(at) - a.sum() - b.sum() + p11, b.sum() - p11], [a.sum() - p11, p11]]), np.array([len(heads) - y[heads].sum(), y[heads].sum()])


def score_texts(model, texts, pows=None, floor=0.5):
    """Scores per text, and its toxic spans as (text index, start, end, marginal) with offsets in code points."""
    data, offs = string_buffers(texts)
    data = folded(data)
    s, e, first = token_spans(data, offs)
    if model["base"] in (0.0, 1.0):
        return np.full(len(texts), model["base"]), np.zeros((0, 4))
    x = token_features(data, s, e, pows)
    m = marginals(model["w"][x].sum(axis=1, dtype=np.float64) + model["bias"], first, model["trans"], model["start"])
    z = document_features(m, first)
    score = 1 / (1 + np.exp(-np.clip(z @ model["doc"][:3] + model["doc"][3], -60, 60)))
    hot = m >= floor
    doc = np.repeat(np.arange(len(texts)), np.diff(first))
    at = np.flatnonzero(hot)
    if not len(at):
        return score, np.zeros((0, 4))
    opens = np.concatenate(([True], (np.diff(at) > 1) | (np.diff(doc[at]) > 0)))
    o = np.flatnonzero(opens)
    closes = at[np.concatenate((o[1:] - 1, [len(at) - 1]))]
    heads = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80, dtype=np.int32)))
    d = doc[at[o]]
    base = heads[offs[d]]
    return score, np.stack([d, heads[s[at[o]]] - base, heads[e[closes]] - base, np.maximum.reduceat(m[at], o)], axis=1)


def _scorer(model):
    def run(batches):
        pows = powers(1 << 21)
        for batch in small_batches(batches):
            score, spans = score_texts(model.value, batch.column("text"), pows)
            per = np.bincount(spans[:, 0].astype(np.int64), minlength=batch.num_rows)
            offs = np.concatenate(([0], np.cumsum(per))).astype(np.int32)
            body = pa.StructArray.from_arrays([pa.array(spans[:, 1].astype(np.int64)), pa.array(spans[:, 2].astype(np.int64)), pa.array(spans[:, 3].astype(np.float64))], names=["start", "end", "score"])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(score), pa.ListArray.from_arrays(pa.array(offs), body)], names=["doc_id", "score", "spans"])

    return run


def held_out(doc_id="doc_id"):
    """True for the rows that are never learnt from, rows without doc_id among them."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(True))


def train(spark, docs, labels, per_class=1500, class_chars=8_000_000):
    """Fit on at most `per_class` toxic and as many clean labelled documents that aren't held out.

    Those of a class have at most `class_chars` characters together and a twentieth of that each, which bounds what the
    driver holds; they are chosen by hash of doc_id.
    """
    known = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(~held_out())
    known = known.join(docs.groupBy("doc_id").agg(F.max(F.coalesce(F.length("text"), F.lit(0))).alias("chars")), "doc_id")
    share = {int(v): c for v, c in known.groupBy("toxic").count().toArrow().to_pandas().itertuples(index=False)}  # two rows
    so_far = F.sum("chars").over(Window.orderBy(F.xxhash64("doc_id"), "doc_id"))  # over per_class rows
    pick = lambda v: known.where((F.col("toxic") == v) & (F.col("chars") <= class_chars // 20)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class).withColumn("so_far", so_far).where(F.col("so_far") <= class_chars).drop("so_far", "chars")
    chosen = pick(1).unionAll(pick(0)).select("doc_id", F.col("toxic").cast("int").alias("toxic")).toArrow()  # at most 2 * per_class ids
    if not chosen.num_rows:
        return fit(pa.array([], pa.string()), [])
    ids = spark.createDataFrame(chosen)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("text").alias("text")).toArrow()
    rows = rows.sort_by("doc_id")
    return fit(rows.column("text").combine_chunks() if rows.num_rows else pa.array([], pa.string()), rows.column("toxic").to_numpy(), share.get(1, 0) / max(1, sum(share.values())))


def toxicity(spark, docs, labels, per_class=1500):
    """Score every document: rows (doc_id, score, spans); spans are code-point offsets with their highest marginal."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    model = spark.sparkContext.broadcast(train(spark, docs, labels, per_class))
    return docs.mapInArrow(_scorer(model), _OUT)
