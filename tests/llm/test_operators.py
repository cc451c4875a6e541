"""Each operator against a brute-force version on awkward rows: nulls, empty and long texts, ties, repeats, clashing columns."""

import collections
import hashlib
import html
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quadrille.llm import cross_parse, mixing, passages
from quadrille.llm._text import powers
from quadrille.llm.cross_parse import whole_parse_scores
from quadrille.llm.cross_polytope import similar_vectors
from quadrille.llm.decontam import RADIUS, block_tables, contamination, lookup
from quadrille.llm.html_main import main_text, main_texts
from quadrille.llm.near_dup import near_duplicates, posterior_bounds
from quadrille.llm.passages import align, chain, repeated_passages, without_passages
from quadrille.llm.suffix_dedup import gram_hashes, may_repeat, permuted_prefixes, repeated_windows, suffix_array, without_repeats
from quadrille.llm.toxicity import fit, marginals, score_texts, toxicity
from quadrille.llm.url_rules import judge, mine
from quadrille.llm.ziv_merhav import Automaton, cross_parse_scores, segments

EXTRA = ["key", "at", "score", "r", "band", "start", "spans", "doc", "good", "h", "own", "anchor"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(seed, n, vocabulary=4000):
    rng = random.Random(seed)
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def awkward(spark, rows):
    """Documents with columns whose names the operators use themselves."""
    df = spark.createDataFrame([(i, t, lang, s, len(t) if t is not None else None) for i, t, lang, s in rows], SCHEMA)
    for c in EXTRA:
        df = df.withColumn(c, F.lit("x"))
    return df


@pytest.fixture(scope="module")
def corpus():
    a, b = words(1, 300), words(2, 240)
    near = list(a)
    near[10], near[200] = "changed", "altered"
    shared = words(3, 70)
    rows = [
        (1, " ".join(a), "en", "s1"),
        (2, " ".join(near), "en", "s1"),
        (3, " ".join(a), "en", "s2"),
        (4, " ".join(b[:100] + shared + b[100:]), "en", "s1"),
        (5, " ".join(words(4, 80) + shared + words(5, 60)), "fr", None),
        (6, None, None, None),
        (7, "", "en", "s1"),
        (8, "   \n\t ", "de", "s2"),
        (9, "two words", "en", "s1"),
        (10, "Two Words", "en", "s1"),
        (11, " ".join(words(6, 30_000)), "en", "s3"),
        (12, "é" * 150 + "ß" * 120 + "é" * 150, "fr", "s1"),
    ]
    return rows


def shingle_set(text, n):
    w = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def test_near_duplicates(spark, corpus):
    got = {r.doc_id: r for r in near_duplicates(spark, awkward(spark, corpus), n=4).collect()}
    sets = {i: shingle_set(t, 4) for i, t, _, _ in corpus}
    low = {i: i for i in sets}
    for _ in sets:
        for i in sets:
            for j in sets:
                both = len(sets[i] & sets[j])
                if both and 100 * both >= 80 * len(sets[i] | sets[j]):
                    low[i] = low[j] = min(low[i], low[j])
    assert {i: (r.n_shingles, r.component_id, r.kept) for i, r in got.items()} == {i: (len(s), low[i], low[i] == i) for i, s in sets.items()}
    assert low[2] == low[3] == 1 and low[10] == 9


def test_near_duplicates_empty_table(spark):
    assert near_duplicates(spark, spark.createDataFrame([], SCHEMA)).count() == 0


def test_posterior_bounds_keep_true_pairs():
    for m, least in posterior_bounds(96, 16, 0.8, 1e-6):
        assert least < 0.8 * m


def test_suffix_array_and_prefixes():
    rng = random.Random(7)
    for _ in range(60):
        s = np.array([rng.randint(1, rng.choice([1, 2, 700])) for _ in range(rng.randint(1, 50))] + [0])
        order = sorted(range(len(s)), key=lambda i: s[i:].tolist())
        sa = suffix_array(s)
        assert sa.tolist() == order
        p = permuted_prefixes(s, sa, 0)
        for a, b in zip(order, order[1:]):
            n = 0
            while b + n < len(s) and a + n < len(s) and s[a + n] == s[b + n]:
                n += 1
            assert p[b] == n
    pieces = [b"abcabcabd", b"xbcab", b"abcabd"]
    seen, want = set(), set()
    for i, piece in enumerate(pieces):
        for o in range(len(piece) - 3):
            if piece[o : o + 4] in seen:
                want.add((i, o))
            seen.add(piece[o : o + 4])
    assert set(zip(*(x.tolist() for x in repeated_windows(pieces, 4)))) == want


def repeats_removed(texts, length=100):
    """(bytes, removed, runs, digest) per text in order, by brute force."""
    seen, out = set(), []
    for t in texts:
        raw = (t or "").encode()
        cover = bytearray(len(raw))
        for s in range(len(raw) - length + 1):
            w = raw[s : s + length]
            if w in seen:
                cover[s : s + length] = b"\1" * length
            seen.add(w)
        kept = bytes(b for b, c in zip(raw, cover) if not c)
        runs = sum(1 for k in range(len(cover)) if cover[k] and not (k and cover[k - 1]))
        out.append((len(raw), sum(cover), runs, hashlib.sha256(kept).hexdigest()))
    return out


def result(r):
    return r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256


def test_without_repeats(spark, corpus):
    got = {r.doc_id: r for r in without_repeats(spark, awkward(spark, corpus)).collect()}
    assert {i: result(r) for i, r in got.items()} == dict(zip([i for i, *_ in corpus], repeats_removed([t for _, t, *_ in corpus])))
    assert got[3].n_removed == got[3].n_bytes and got[12].n_removed > 0
    assert without_repeats(spark, spark.createDataFrame([], SCHEMA)).count() == 0


def test_without_repeats_repeated_rows_and_null_ids(spark):
    a, b = (" ".join(words(i, 60)) for i in (1, 2))
    rows = [(1, a), (1, a), (2, b + a), (None, a + b), (None, b), (4, a), (4, b), (None, None), (5, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    picks = {(r.doc_id, r.text): r.h for r in docs.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("h", F.xxhash64("text")).collect()}
    order = sorted(picks, key=lambda x: (x[0] is not None, x[0] or 0, picks[x]))
    want = collections.Counter((i, *x) for (i, _), x in zip(order, repeats_removed([t for _, t in order])))
    assert collections.Counter((r.doc_id, *result(r)) for r in without_repeats(spark, docs).collect()) == want
    one = {r.doc_id: r.n_removed for r in without_repeats(spark, docs.where("doc_id in (1, 5) or doc_id = 2")).collect()}
    assert one == {1: 0, 2: len(a), 5: 0}


def test_without_repeats_splits_a_hot_anchor(spark):
    """One phrase in many contexts is far more than a shard; some contexts repeat, some in part."""
    phrase, rng, rows = "the phrase that all documents share", random.Random(8), []
    filler = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    for i in range(300):
        rows.append((i, filler(90) + phrase + filler(90)))
    for i in range(300, 340):
        source = rows[i - 200][1]
        rows.append((i, filler(30) + source[i % 40 :] if i % 2 else source[:170] + filler(40)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: result(r) for r in without_repeats(spark, docs, shard_bytes=500).collect()}
    assert got == dict(zip([i for i, _ in rows], repeats_removed([t for _, t in rows])))
    assert sum(x[1] > 0 for x in got.values()) == 40


def test_chance_neighbours_of_an_anchor_are_not_sorted():
    """Pieces that agree in less than a window's length beside their anchor go before suffixes are sorted; windows in common stay."""
    rng, gram, length = random.Random(12), 24, 100
    filler = lambda n: bytes(rng.choice(b"abcdefghij ") for _ in range(n))
    word = filler(gram)
    sums = gram_hashes(np.frombuffer(word, dtype=np.uint8), gram, powers(1 << 10))[1]
    left = filler(50)
    rows = [(i, 0, filler(20) + left + word + filler(70)) for i in range(30)]  # 74 bytes in common
    assert not may_repeat(int(sums[0].view(np.int64)), rows, length, gram)
    source = filler(76) + word + filler(76)
    mixed = [(0, 0, source)] + [(i, 10 * i, filler(rng.randint(0, 76 - x)) + source[76 - x : 176 - x] + filler(rng.randint(0, x))) for i, x in enumerate(range(77), 1)]
    kept = may_repeat(int(sums[0].view(np.int64)), mixed, length, gram)
    found = lambda rows: {(d, lo + int(o)) for (d, lo, _), o in ((rows[p], o) for p, o in zip(*repeated_windows([r[2] for r in rows], length)))}
    assert found(kept) == found(mixed) and len(found(mixed)) >= 77


def test_chain_prefers_collinear_matches():
    x, y = [0, 10, 20, 30, 30], [5, 15, 25, 35, 2]
    assert chain(x, y, 8)[0] == [0, 1, 2, 3]


def test_passages_and_cut(spark, corpus):
    docs = awkward(spark, corpus)
    found = repeated_passages(spark, docs)
    rows = found.collect()
    pairs = {(r.doc_id, r.src_id) for r in rows}
    assert {(2, 1), (3, 1), (5, 4)} <= pairs and all(r.src_id < r.doc_id for r in rows)
    p = next(r for r in rows if (r.doc_id, r.src_id) == (5, 4))
    assert (p.start, p.end) == (80, 150) and (p.src_start, p.src_end) == (100, 170)
    cut = {r.doc_id: r for r in without_passages(spark, docs, found).collect()}
    assert len(cut) == len(corpus) and cut[3].text == "" and cut[6].text is None
    text = dict((i, t) for i, t, _, _ in corpus)[5].split()
    assert cut[5].text.split() == text[:80] + text[150:] and cut[5].n_chars == len(cut[5].text)
    assert cut[4].text == dict((i, t) for i, t, _, _ in corpus)[4]
    assert repeated_passages(spark, spark.createDataFrame([], SCHEMA)).count() == 0


def test_lookup_holds_every_near_fingerprint_and_prunes():
    rng = np.random.default_rng(2)
    items = rng.integers(0, 2**63, 300, dtype=np.uint64)
    far = items.copy()
    for k in range(len(far)):
        for bit in rng.choice(64, RADIUS, replace=False):
            far[k] ^= np.uint64(1 << int(bit))
    window, item = lookup(block_tables(items), len(items), far)
    assert {(k, k) for k in range(len(items))} <= set(zip(window.tolist(), item.tolist()))
    assert len(window) < 0.25 * len(items) ** 2


def test_windows_at_the_threshold_are_within_the_radius(spark):
    """Recall of the lookup against exhaustive similarity of every item-sized window."""
    rng, items, rows = random.Random(12), [], []
    for k in range(60):
        items.append((k, " ".join(words(700 + k, rng.choice([50, 60, 80]), 3000))))
        w = items[-1][1].split()
        for _ in range(3):
            x = list(w)
            for i in rng.sample([0, 1, 2, len(x) - 2, len(x) - 1, len(x) // 2], rng.randint(0, 2)):
                x[i] = f"z{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(words(9000 + len(rows), 20, 3000) + x + words(9500 + len(rows), 20, 3000))))
    got = {(r.doc_id, r.item_id) for r in contamination(spark, spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    grams = lambda w: collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    df = collections.Counter(g for _, t in items for g in grams(t.split()))
    weight = lambda g: round(1024 * (1 + np.log((1 + len(items)) / (1 + max(1, df[g])))))
    want = set()
    for d, t in rows:
        w = t.split()
        for k, item in items:
            a = grams(item.split())
            if not set(a) & set(grams(w)):
                continue
            size = len(item.split())
            for i in range(len(w) - size + 1):
                b = grams(w[i : i + size])
                both = sum(weight(g) * c for g, c in (a & b).items())
                if both >= 0.8 * (sum(weight(g) * c for g, c in (a | b).items())):
                    want.add((d, k))
    assert got <= want and len(want) > 100 and len(got) >= 0.99 * len(want)


def test_contamination(spark, corpus):
    item = words(40, 30)
    rows = [*corpus, (20, " ".join(words(41, 50) + item + words(42, 50)), "en", "s1"), (21, " ".join(words(43, 20) + item[:-1] + ["other"]), "en", "s1"), (22, " ".join(words(44, 20) + item[:12] + words(45, 20)), "en", "s1"), (23, " ".join(item), "en", "s1")]
    bench = spark.createDataFrame([(1, " ".join(item)), (2, None), (3, ""), (4, "too short"), (5, " ".join(item)), (None, "a b c d e f")], "item_id long, text string")
    got = contamination(spark, awkward(spark, rows), bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(d, i) for d in (20, 21, 23) for i in (1, 5)}
    text = dict((i, t) for i, t, _, _ in rows)[20]
    r = next(r for r in got if r.doc_id == 20 and r.item_id == 1)
    assert text[r.start : r.end] == " ".join(item) and r.hamming == 0 and r.similarity == 1.0
    assert contamination(spark, awkward(spark, rows), bench.limit(0)).count() == 0
    blocks = contamination(spark, awkward(spark, rows), bench, block_words=10)
    assert {(r.doc_id, r.item_id) for r in blocks.collect()} == {(r.doc_id, r.item_id) for r in got}


def test_marginals_against_enumeration():
    import itertools

    rng = np.random.default_rng(0)
    first, emit, trans, start = np.array([0, 3, 3, 8]), rng.normal(size=8) * 2, rng.normal(size=(2, 2)), rng.normal(size=2)
    want = []
    for a, b in zip(first[:-1], first[1:]):
        total, acc = 0.0, np.zeros(b - a)
        for y in itertools.product([0, 1], repeat=b - a) if b > a else []:
            p = np.exp(start[y[0]] + sum(emit[a + i] * y[i] for i in range(b - a)) + sum(trans[y[i - 1], y[i]] for i in range(1, b - a)))
            total, acc = total + p, acc + p * np.array(y)
        want += list(acc / total) if b > a else []
    assert np.allclose(marginals(emit, first, trans, start), want)


def toxic_text(seed, bad):
    w = words(seed, 60, 300)
    if bad:
        for k in (5, 25, 45):
            w[k] = random.Random(seed + k).choice(["vilest", "vilething", "rottenx"])
    return " ".join(w)


def test_toxicity_held_out(spark):
    rows = [(i, toxic_text(i, i % 4 == 0), "en", "s") for i in range(600)] + [(900, None, "en", "s"), (901, "", "en", "s"), (None, "no id", "en", "s")]
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(600)] + [(3, 0, 0), (7, None, None)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity(spark, awkward(spark, rows), labels).collect()}
    assert len(got) == 603 and all(0 <= r.score <= 1 for r in got.values())
    assert np.mean([(got[i].score >= 0.5) == (i % 4 == 0) for i in range(600)]) > 0.97
    text = dict((i, t) for i, t, _, _ in rows)[8]
    spans = {text[s.start : s.end] for s in got[8].spans}
    assert spans and all(x in {"vilest", "vilething", "rottenx"} for x in spans)
    none = toxicity(spark, awkward(spark, rows[:3]), labels.limit(0)).collect()
    assert [r.score for r in none] == [0.0] * 3


def test_toxicity_without_both_labels():
    model = fit(pa.array(["a b"]), [1])
    assert score_texts(model, pa.array(["a", ""]))[0].tolist() == [1.0, 1.0]


def deviation(spark, rows, weights, block=1, **more):
    """Worst distance in blocks between what a source was served and its given weight, until the first source runs out."""
    got = mixing.mix(spark, rows, weights, block=block, **more).collect()
    assert sorted(r.position for r in got) == list(range(len(got)))
    slots, served = collections.defaultdict(set), collections.Counter()
    for r in got:
        slots[r.source].add(r.slot)
        served[r.source, r.slot] += 1
    order = sorted(got, key=lambda r: r.position)
    assert all(a.slot <= b.slot for a, b in zip(order, order[1:])) and max(served.values()) <= block
    last, worst, total = min(max(v) for v in slots.values()), 0.0, sum(weights.values())
    for s, at in slots.items():
        done = 0
        for t in range(last + 1):
            worst = max(worst, abs(done - weights[s] / total * t))
            done += t in at
    return worst, last


def sourced(spark, sizes):
    return spark.createDataFrame([(i, s) for s, n in sizes.items() for i in range(n)], "doc_id long, source string")


def test_mixing_deviation_and_places(spark):
    rows = [(i, "t", "en", s) for i, s in enumerate(["a"] * 700 + ["b"] * 200 + ["c"] * 100 + [None] * 50)] + [(5, "t", "en", "a"), (None, "t", "en", "b")]
    assert deviation(spark, awkward(spark, rows), {"a": 5.0, "b": 3.0, "c": 1.0, None: 1.0}, block=8, rows_per_bucket=100)[0] < 1
    assert mixing.mix(spark, spark.createDataFrame([], SCHEMA)).count() == 0
    with pytest.raises(ValueError):
        mixing.mix(spark, awkward(spark, rows), {"a": 1.0}).count()


def test_mixing_keeps_given_weights_over_many_periods(spark):
    worst, last = deviation(spark, sourced(spark, {"a": 5700, "b": 300}), {"a": 0.95, "b": 0.05})
    assert worst < 1 and last > 5000
    many = {f"s{i}": 0.001 for i in range(99)}
    worst, last = deviation(spark, sourced(spark, {"a": 2703} | dict.fromkeys(many, 3)), {"a": 0.901} | many)
    assert worst < 1 and last > 2000
    worst, last = deviation(spark, sourced(spark, {"a": 2100, "b": 600, "c": 180, "d": 60, "e": 60}), {"a": 0.7, "b": 0.2, "c": 0.06, "d": 0.02, "e": 0.02}, block=3)
    assert worst < 1 and last > 900


def test_mixing_any_number_of_sources(spark):
    df = spark.range(2200).select(F.col("id").alias("doc_id"), (F.col("id") % 1100).cast("string").alias("source"))
    assert sorted(r.position for r in mixing.mix(spark, df).collect()) == list(range(2200))


def test_url_rules(spark):
    urls = [
        (1, "https://A.Example.ORG/es/1?x#y", "block", "example.org/es/"),
        (2, "http://x.example.org/en/15", "block", "example.org/en/1"),
        (3, "http://x.org/", "allow", "org/"),
        (4, "http://x.com/fr/1", "allow", "com/fr/"),
        (5, "http://x.com/de/1", "block", "com/de/"),
        (6, "http://notexample.org/es/1", "allow", "org/"),
        (7, "no scheme", "allow", None),
        (8, None, "allow", None),
        (9, "http://bad.net/spam/7", "block", None),
        (9, "http://bad.net/spam/7", "block", None),
        (None, "http://good.net/news/1", "allow", None),
        (11, "http://x.org", "allow", None),
    ]
    rng = random.Random(3)
    train = [(100 + i, f"http://bad.net/spam/{i}") for i in range(60)] + [(200 + i, f"http://good.net/news/{i}") for i in range(60)]
    pages = spark.createDataFrame([(i, u) for i, u, _, _ in urls] + train, "page_id long, url string").withColumn("host", F.lit("clash")).withColumn("rule", F.lit("clash"))
    labels = spark.createDataFrame([(i, 0 if i < 200 else 1, 0) for i, _ in train] + [(1, None, None)], "doc_id long, quality int, toxic int")
    got = collections.Counter((r.page_id, r.verdict, r.rule) for r in judge(spark, pages, labels).collect())
    assert all(got[(i, v, r)] == sum(1 for x in urls if x[0] == i and x[2:] == (v, r)) for i, _, v, r in urls)
    row = judge(spark, pages.where("page_id = 1"), labels.limit(0)).first()
    assert (row.host, row.path) == ("a.example.org", "/es/1") and rng
    assert judge(spark, pages.limit(0), labels).count() == 0


def test_html_main_text(spark):
    page = '<html><head><title>T</title><style>p{}</style></head><body><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="cookie-notice"><p>We use cookies.</p></div><article><header><h1>Head &amp; line</h1></header><p>First  para,\n with <b>bold</b> text.<p>Second&nbsp;para.<div class="comments"><p>I agree, really.</p></div><form><p>Sign up</p></form></article><aside><p>Aside text.</p></aside><footer>(c)</footer><script>if (a<b) "</p>"</script></body>'
    assert main_text(page) == "Head & line\nFirst para, with bold text.\nSecond para."
    plain = '<body><div id="menu"><a href=x>a</a> <a href=y>b</a></div><div class="story"><h2>Title</h2><p>A long paragraph, with commas. And sentences.</p><p>Another one; fine.</p><ul><li>short item</li></ul></div><div class="footer">x</div></body>'
    assert main_text(plain) == "Title\nA long paragraph, with commas. And sentences.\nAnother one; fine.\nshort item"
    rows = [(1, "u", page), (2, "u", None), (3, None, ""), (3, None, ""), (4, "u", "<p>unclosed <b>text"), (5, "u", "just text"), (6, "u", "<" * 50), (7, "u", "<article><p>" + "long text. " * 50_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = sorted((r.page_id, r.text, r.n_chars) for r in main_texts(spark, df).collect())
    assert got == sorted((i, main_text(h), len(main_text(h))) for i, _, h in rows)
    assert dict((i, t) for i, t, _ in got)[4] == "unclosed text" and html.unescape("&amp") == "&"


def test_html_names_that_wrap_the_main_text():
    body = "<article><div class='article-header'><h1>Head</h1></div><p class='share'>Shares rose, they said.</p><p>Where <math><mi>x</mi></math> is small.</p><object><p>A drawing.</p></object><noscript><p>Read on.</p></noscript><div class='ad'>Buy!</div><p>The end, at last.</p></article>"
    want = "Head\nShares rose, they said.\nWhere x is small.\nA drawing.\nRead on.\nThe end, at last."
    for wrap in ("<div class='has-sidebar'>%s</div>", "<div id='content-sidebar-wrap'>%s</div>", "<div class='sidebar'>%s</div>"):
        assert main_text("<body>" + wrap % body + "<div class='footer'>(c)</div><noscript>Enable scripts.</noscript></body>") == want
    plain = "<p>A long paragraph, with commas. And sentences.</p><p>Another one; fine.</p>"
    assert main_text(f"<body><div class='widget'>{plain}</div><div class='nav'>Home</div></body>") == "A long paragraph, with commas. And sentences.\nAnother one; fine."
    teaser = "<div class='sidebar'><article><p>Also read this, now.</p></article></div>"
    assert main_text(f"<body><div class='has-sidebar'>{body}{teaser}</div></body>") == want
    assert main_text("<p>Text.</p><div class='ad'>Buy!</div>") == "Text."


def greedy_phrases(q, ref):
    """Phrases of the greedy longest-match parse, by brute force."""
    inside = {tuple(r[i:j]) for r in ref for i in range(len(r)) for j in range(i + 1, len(r) + 1)}
    i = c = 0
    while i < len(q):
        n = 1
        while i + n < len(q) and tuple(q[i : i + n + 1]) in inside:
            n += 1
        i, c = i + n, c + 1
    return c


def test_automaton_parses_greedily_and_leaves_a_document_out():
    rng = random.Random(1)
    for _ in range(150):
        ref = [[rng.choice("abc") for _ in range(rng.randint(0, 12))] for _ in range(rng.randint(0, 5))]
        a = Automaton()
        for k, r in enumerate(ref):
            a.add(r, k // 2)  # some documents have two texts
        q = [rng.choice("abcd") for _ in range(rng.randint(0, 20))]
        assert a.phrases(q) == greedy_phrases(q, ref)
        for own in range(3):
            assert a.phrases(q, own) == greedy_phrases(q, [r for k, r in enumerate(ref) if k // 2 != own])


def test_cross_parse_scores(spark, corpus):
    good = spark.createDataFrame([(i,) for i in (1, 2, 4, None)], "doc_id long")
    got = {r.doc_id: r for r in cross_parse_scores(spark, awkward(spark, corpus), good).collect()}
    assert len(got) == len(corpus)
    cut = dict(zip([i for i, *_ in corpus], segments(pa.array([t for _, t, *_ in corpus], pa.string()))))
    lang = {i: x for i, _, x, _ in corpus}
    for i, t, _, _ in corpus:  # one shard a language: the parse against the whole reference but the document itself
        parts = [p.lower().split() for p, _, _ in cut[i]]
        assert sum(parts, []) == (t or "").lower().split() and got[i].n_words == sum(n for _, n, _ in cut[i])
        ref = [p.lower().split() for k in (1, 2, 4) if k != i and lang[k] == lang[i] for p, _, _ in cut[k]]
        if got[i].n_words < 1000:
            c = sum(greedy_phrases(p, ref) for p in parts)
            m = sum(len(p) for k in (1, 2, 4) if lang[k] == lang[i] for p, _, _ in [(x[0].split(), 0, 0) for x in cut[k]])
            assert got[i].n_phrases == c and (got[i].score is None) == (got[i].n_words == 0) and got[i].n_reference == m
            assert not c or abs(got[i].cross_bits - c * np.log2(max(2, m)) / got[i].n_words) < 1e-9
    assert got[3].n_phrases == len(cut[3]) and got[11].n_phrases > 20_000
    assert cross_parse_scores(spark, awkward(spark, corpus), good.limit(0)).count() == len(corpus)
    assert cross_parse_scores(spark, spark.createDataFrame([], SCHEMA), good).count() == 0


def test_cross_parse_sends_copies_to_one_shard(spark):
    shared = words(999, 150)
    rows = [(i, " ".join(words(i, 120)), "en" if i % 3 else None) for i in range(60)]
    rows += [(100 + i, t, x) for i, t, x in rows[:20]] + [(200 + i, rows[5][1], rows[5][2]) for i in range(30)] + [(None, rows[7][1], rows[7][2]), rows[8]]
    rows += [(300 + i, " ".join(words(50 + i, 90) + shared + words(80 + i, 70)), "en") for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    good = spark.createDataFrame([(i,) for i in [*range(60), *range(200, 230), 303]], "doc_id long")
    got = cross_parse_scores(spark, docs, good, shard_words=400, run_words=500).collect()
    assert len(got) == len(rows) and max(r.n_reference for r in got) < 5000
    size = {i: len(x) for (i, *_), x in zip(rows, segments(pa.array([t for _, t, _ in rows])))}
    assert all(r.n_phrases == size[r.doc_id] for r in got if r.doc_id is None or 100 <= r.doc_id < 300)
    assert all(r.n_phrases < r.n_words - 60 for r in got if r.doc_id is not None and r.doc_id >= 300 and r.doc_id != 303)  # the passage is found in 303


def test_segments_cut_copies_alike():
    passage = words(5, 400)
    a, b = (list(x)[0] for x in (segments(pa.array([" ".join(words(6, 77) + passage + words(7, 50))])), segments(pa.array([" ".join(passage + words(8, 99))]))))
    assert all(16 <= n <= 256 for _, n, _ in a[:-1]) and sum(n for _, n, _ in a) == 527
    both = {t: n for t, n, _ in a if t in {x for x, _, _ in b}}
    assert sum(both.values()) >= 250
    assert [n for _, n, _ in next(segments(pa.array(["la " * 1000])))][:1] and next(segments(pa.array(["", None, "a b"]))) == [("", 0, 0)]


def test_similar_vectors(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(30, 20))
    rows, n = [], 0
    for b in base:
        for _ in range(6):
            rows.append((n, (b + rng.normal(size=20) * rng.choice([0.01, 0.1, 0.18])).tolist(), int(n % 2)))
            n += 1
    rows += [(n, rows[0][1], rows[0][2]), (n + 1, None, 1), (n + 2, [0.0] * 20, 1), (n + 3, [float("nan")] * 20, 1), (n + 4, rows[0][1], None), (n + 5, [], 1), (n + 6, [1.0, None], 1), (n + 7, [x * 3 for x in rows[0][1]], rows[0][2])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("key", F.lit(1)).withColumn("keys", F.lit(1))
    got = {r.vec_id: r for r in similar_vectors(spark, df, block=4).collect()}
    usable = {}
    for i, e, lab in rows:
        if lab is not None and e and None not in e and np.isfinite(e).all() and np.any(e):
            v = np.array(e, dtype=np.float32).astype(float)
            usable[i] = (lab, v / np.linalg.norm(v))
    links = {i: {j for j, (lj, w) in usable.items() if j != i and lj == li and len(w) == len(v) and v @ w >= 0.98} for i, (li, v) in usable.items()}
    low = {i: i for i, _, _ in rows}
    for _ in range(20):
        for i, js in links.items():
            m = min([low[i], *(low[j] for j in js)])
            for j in (i, *js):
                low[j] = min(low[j], m)
    assert {i: (r.n_links, r.component_id, r.kept) for i, r in got.items()} == {i: (len(links.get(i, ())), low[i], low[i] == i) for i, _, _ in rows}
    assert similar_vectors(spark, df.limit(0)).count() == 0


def edited(rng, text, share):
    """The text with a share of its words, at random places, replaced."""
    out = list(text)
    for i in rng.sample(range(len(out)), round(share * len(out))):
        out[i] = f"e{rng.randrange(10**6)}"
    return out


def test_edited_passages_are_found(spark):
    """Passages with 0 to 18 % of their words replaced; by construction their identity is 0.82 at least."""
    rng, rows, cases = random.Random(9), [], []
    for share in (0.02, 0.05, 0.1, 0.15, 0.18):
        for n in (60, 100, 200):
            for _ in range(20):
                i, text = len(rows) * 10, words(1000 + len(rows), n, 40000)
                rows += [(i, words(9000 + i, 30, 40000) + text + words(9001 + i, 30, 40000)), (i + 1, words(9002 + i, 40, 40000) + edited(rng, text, share) + words(9003 + i, 20, 40000))]
                cases.append((share, n, i))
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
    covered = collections.defaultdict(set)
    for r in repeated_passages(spark, docs).collect():
        assert r.identity >= 0.8 and r.end - r.start >= 50
        covered[r.doc_id].update(range(r.start, r.end))
    recall, stray = collections.defaultdict(list), 0
    for share, n, i in cases:
        got, inside = covered[i + 1], set(range(40, 40 + n))
        recall[share, n].append(len(got & inside) / n)
        stray += len(got - inside)
    means = {key: sum(x) / len(x) for key, x in recall.items()}
    assert min(v for (share, _), v in means.items() if share <= 0.1) >= 0.95, means
    assert min(means.values()) >= 0.85, means
    assert stray <= 0.01 * sum(n for _, n, _ in cases)


def test_repeats_whose_parts_first_occur_apart(spark):
    """Exact repeats across several sources, and runs of one word that an earlier document has shorter."""
    x, y, z, run = words(70, 40, 40000), words(71, 40, 40000), words(72, 40, 40000), ["la"] * 120
    w = lambda i: words(800 + i, 30, 40000)
    rows = [(1, w(1) + x + w(2)), (2, w(3) + y + w(4)), (3, x + y + w(5)), (4, w(6) + x + w(7)), (5, w(8) + y + w(9)), (6, w(10) + x + y + w(11))]
    rows += [(11, x + y + w(12)), (12, y + z + w(13)), (13, w(14) + x + y + z), (14, w(15) + x + w(16)), (15, y + w(17) + z), (16, w(18) + x + y + z + w(19))]
    rows += [(21, w(20) + run[:20] + w(21)), (22, w(22) + run + w(23)), (23, run[:30] + w(24)), (24, w(25) + run + w(26))]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in rows], "doc_id long, text string")
    covered = collections.defaultdict(set)
    for r in repeated_passages(spark, docs).collect():
        covered[r.doc_id].update(range(r.start, r.end))
    assert set(range(30, 110)) <= covered[6] and set(range(30, 150)) <= covered[16] and set(range(30, 150)) <= covered[24]
    seen = set()
    for i, t in rows:  # brute force: every run of 50 words that an earlier document holds is covered
        grams = [tuple(t[j : j + 50]) for j in range(len(t) - 49)]
        assert all(set(range(j, j + 50)) <= covered[i] for j, g in enumerate(grams) if g in seen)
        seen.update(grams)


def components(sets, percent):
    """Smallest id reachable by links of sets at the threshold, by brute force over pairs that share an element."""
    low, by = {i: i for i in sets}, collections.defaultdict(list)
    for i, x in sets.items():
        for g in x:
            by[g].append(i)
    pairs = {i: collections.Counter(j for g in x for j in by[g] if j > i) for i, x in sets.items()}
    links = [(i, j) for i, c in pairs.items() for j, both in c.items() if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both)]
    while True:
        before = dict(low)
        for i, j in links:
            low[i] = low[j] = min(low[i], low[j])
        if before == low:
            return low


def test_near_duplicates_hot_bucket_and_repeated_rows(spark):
    """Documents of one template share buckets without links; the few links among them are found all the same."""
    common, rows = words(1, 120), []
    for i in range(500):
        rows.append((i, " ".join(common + words(5000 + i, 50, 10**6))))
    for i in range(0, 60, 3):  # an edited copy of a template document
        own = words(5000 + i, 50, 10**6)
        own[25] = "edited"
        rows.append((1000 + i, " ".join(common + own)))
    rows += [rows[0], rows[3], (7, "another text for a known id"), (7, rows[7][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = near_duplicates(spark, docs, n=4, block=16).collect()
    assert len(got) == len({i for i, _ in rows}) == len({r.doc_id for r in got})
    chosen = {r.doc_id: t for r in got for i, t in rows if i == r.doc_id and len(shingle_set(t, 4)) == r.n_shingles}
    low = components({i: shingle_set(t, 4) for i, t in chosen.items()}, 80)
    assert {r.doc_id: r.component_id for r in got} == low and low[1003] == 3


def test_passages_with_repeated_ids(spark):
    p, w = words(1, 80), lambda i: words(100 + i, 30)
    rows = [(1, p + w(1)), (5, ["short"]), (5, w(2) + p + w(3)), (6, w(4) + p), (6, w(4) + p), (None, p)]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in rows], "doc_id long, text string")
    pick = min((r.h, r.text) for r in docs.where("doc_id = 5").withColumn("h", F.xxhash64("text")).collect())[1]
    got = {(r.doc_id, r.src_id, r.start, r.end) for r in repeated_passages(spark, docs).collect()}
    want = {(6, 1, 30, 110)} | ({(5, 1, 30, 110)} if len(pick) > 5 else set())
    assert {(d, s) for d, s, *_ in want} <= {(d, s) for d, s, *_ in got} and all(e - s >= 80 for _, _, s, e in got)


def test_html_ratios_select():
    text = "<p>A long paragraph, with commas. And sentences that go on for a while.</p><p>Another one; it is fine, too.</p>"
    want = "A long paragraph, with commas. And sentences that go on for a while.\nAnother one; it is fine, too."
    for wrap in ("<div class='site has-sidebar'>%s</div>", "<div class='wrapper no-sidebar'>%s</div>", "<div id='page' class='search-page'>%s</div>", "<div class='content comments-open'>%s</div>", "<form action='x'>%s</form>"):
        for body in (text, f"<article>{text}</article>"):
            assert main_text("<body>" + wrap % body + "</body>") == want
    assert main_text(f"<body><article class='blog comments-open'>{text}</article></body>") == want
    stray = "<div>12</div><div><span>Buy now</span></div><div hidden><p>Not shown, ever.</p></div>"
    assert main_text(f"<body><article>{stray}{text}</article></body>") == want
    menu = "<ul><li><a href='a'>Home</a></li><li><a href='b'>About us</a></li></ul>"
    assert main_text(f"<body><div>{menu}<div>{stray}{text}</div></div></body>") == want
    assert main_text(f"<body><div>{menu}{stray}{text}</div></body>") == want
    assert main_text(f"<body><div class='story'>{text}<h2>Points</h2><ul><li>one</li><li>two</li></ul><table><tr><td>12</td></tr></table></div></body>") == want + "\nPoints\none\ntwo\n12"
    notices = "<div class='cookie-notice'><p>We use cookies, as you know.</p></div><div class='ad-slot'>Cheap, cheap!</div><form><p>Sign up, please.</p></form>"
    readers = "<section id='comments'>" + "<p>I liked this text a lot, and so did many other readers of it, as they said.</p>" * 6 + "</section>"
    assert main_text(f"<body><div class='page'>{notices}{text}{readers}</div></body>") == want
    assert main_text(f"<body>{notices}<main>{text}<div class='newsletter-box'>Our letter, weekly.</div></main>{readers}</body>") == want
    assert main_text("<body><div class='comments'><p>All there is, is this.</p></div></body>") == "All there is, is this."


def test_url_rules_against_enumeration(spark):
    """Mined rules, their support and confidence against all token sets of the labelled rows."""
    import itertools

    rng, hosts, parts = random.Random(21), ["a.net", "b.net", "c.org"], ["x", "y", "z", "w"]
    rows = []
    for i in range(300):
        h, ps = rng.choice(hosts), rng.sample(parts, rng.randint(1, 3))
        bad = ("x" in ps and h == "a.net") or (rng.random() < 0.8 if "y" in ps and "z" in ps else rng.random() < 0.15)
        rows.append((f"http://{h}/" + "/".join(ps) + f"/{i}", bad))
    got = {tuple(r.antecedent): (r.confidence, r.support) for r in mine(spark, spark.createDataFrame(rows, "url string, bad boolean"), min_support=0.05, min_confidence=0.6).collect()}
    sets = [({f"h:{x}" for x in u.split("/")[2].split(".")} | {f"p:{x}" for x in u.split("/")[3:-1]}, b) for u, b in rows]
    every, rules = sorted(set().union(*[s for s, _ in sets])), {}
    for n in range(1, 7):
        for c in itertools.combinations(every, n):
            held = [b for s, b in sets if s >= set(c)]
            if sum(held) >= max(20, 0.05 * len(rows)) and sum(held) >= 0.6 * len(held):
                rules[c] = (sum(held) / len(held), sum(held) / len(rows))
    want = {c: x for c, x in rules.items() if not any(set(d) < set(c) and y[0] >= x[0] for d, y in rules.items())}
    assert set(got) == set(want) and got and all(abs(got[c][k] - want[c][k]) < 1e-9 for c in want for k in (0, 1))


def test_similar_vectors_hot_bucket(spark):
    """Many vectors around one direction share buckets without links; the links among them are found after longer keys too."""
    rng = np.random.default_rng(9)
    centre = rng.normal(size=32)
    x = [centre + rng.normal(size=32) * 0.45 for _ in range(500)]
    x += [x[i] + rng.normal(size=32) * 0.03 for i in range(0, 500, 10)]
    df = spark.createDataFrame([(i, [float(a) for a in v], 1) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: r for r in similar_vectors(spark, df, block=16, hot=40).collect()}
    unit = np.array([np.float32(v) for v in x]).astype(float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    close = unit @ unit.T >= 0.98
    np.fill_diagonal(close, False)
    found, want = sum(r.n_links for r in got.values()), int(close.sum())
    assert all(got[i].n_links <= close[i].sum() for i in got) and 100 <= want and found >= 0.98 * want
    assert (unit @ unit.T >= 0.6).mean() > 0.5


def test_passages_whose_seeds_occur_elsewhere_first_and_last(spark):
    """Every phrase of an edited passage stands alone in documents before and after its source too."""
    rng = random.Random(31)
    passage = words(91, 120)
    around = lambda i: " ".join(words(400 + i, 30))
    copy = lambda a: " ".join(w if j % 30 != a else f"edit{a}x{j}" for j, w in enumerate(passage))
    pieces = [passage[j : j + 7] for j in range(0, len(passage) - 3, 4)]

    def scattered(seed):
        order = pieces[:]
        random.Random(seed).shuffle(order)
        return " ".join(" ".join([*p, *(f"f{rng.random():.12f}" for _ in range(5))]) for p in order)

    rows = [(i, scattered(i)) for i in range(10)] + [(10, around(10) + " " + copy(3) + " " + around(11))]
    rows += [(i, scattered(i)) for i in range(11, 20)] + [(20, around(20) + " " + copy(18) + " " + around(21))]
    got = repeated_passages(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()
    found = [r for r in got if (r.doc_id, r.src_id) == (20, 10)]
    assert len(found) == 1 and found[0].end - found[0].start >= 100, got
    assert {r.doc_id for r in got} == {20}


def test_similar_vectors_find_the_same_in_hot_buckets(spark):
    """What is found depends on the vectors only, not on how many share their buckets."""
    rng = np.random.default_rng(10)
    centre = rng.normal(size=32)
    x = [centre + rng.normal(size=32) * 0.45 for _ in range(200)]
    x += [v + rng.normal(size=32) * 0.18 for v in x]
    df = spark.createDataFrame([(i, [float(a) for a in v], 1) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int")
    hot, cold = (sorted(similar_vectors(spark, df, tables=1, functions=1, block=16, hot=h).collect()) for h in (10, 10**6))
    assert hot == cold and sum(r.n_links for r in cold) > 100


def test_long_gaps_of_a_chain_are_aligned():
    """A gap without seeds counts by its words in common, however long it is."""
    rng = np.random.default_rng(12)
    flank, gap, tail = (rng.integers(0, 1 << 16, n).astype("<u2") for n in (400, 450, 400))
    other = gap.copy()
    other[::3] ^= 1  # no four words in a row are left
    a, b = np.concatenate((flank, gap, tail)), np.concatenate((flank, [np.uint16(7)], other, tail)).astype("<u2")
    x = [*range(0, 396, 3), *range(850, 1246, 3)]
    y = [i if i < 400 else i + 1 for i in x]
    (found,) = align(a, b, x, y, 4, 50, 0.8)
    assert found[:4] == (0, len(a), 0, len(b)) and found[4] >= 1100 / len(b)


def test_long_documents_do_not_travel_with_each_chain(spark):
    """Chains of one long source carry the words around them; those that need more give what whole documents give."""
    long, shared = words(95, 6000, 40000), words(96, 900, 40000)
    rows = [(0, " ".join(long[:3000] + shared + long[3000:]))]
    rows += [(1 + i, " ".join(words(700 + i, 20, 40000) + long[i * 100 : i * 100 + 70] + words(800 + i, 20, 40000))) for i in range(25)]
    rows += [(30, " ".join(words(97, 200, 40000) + [w if j % 3 else f"x{j}" for j, w in enumerate(shared)] + words(98, 9, 40000)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sketches = docs.mapInArrow(passages._sketcher, "doc_id long, words binary").cache()
    chains = spark.createDataFrame([(30, 0, [700, 740], [3500, 3540]), *((1 + i, 0, [20, 60], [i * 100, i * 100 + 40]) for i in range(25))], "doc_id long, src_id long, xs array<int>, ys array<int>")
    near = passages.around(chains, sketches, 4, 64).collect()
    assert len(near) == 26 and max(len(r.words) + len(r.src_words) for r in near) <= 4 * (44 + 2 * 64)
    whole = {i: [r.words for r in sketches.where(f"doc_id = {i}").collect()][0] for i in (0, 30)}
    a, b = (np.frombuffer(whole[i], "<u2") for i in (30, 0))
    parts = {r.doc_id: r for r in near}
    x, y = (np.frombuffer(w, "<u2") for w in (parts[30].words, parts[30].src_words))
    assert (x == a[parts[30].low : parts[30].low + len(x)]).all() and (y == b[parts[30].src_low : parts[30].src_low + len(y)]).all()
    assert align(a, b, [700, 740], [3500, 3540], 4, 50, 0.6)[0][1] > 1000
    assert align(x, y, [64, 104], [64, 104], 4, 50, 0.6, (True, True), (True, True)) is None  # goes on beyond those words
    found = {(r.doc_id, r.src_id): r for r in repeated_passages(spark, docs).collect()}
    assert all((r.start, r.end, r.src_start) == (20, 90, i * 100) for i, r in ((i, found[1 + i, 0]) for i in range(25)))


def test_seeds_that_occur_once_are_not_sorted_with_the_rest():
    """Matches are those of the seeds that occur again, and none where no seed does."""
    seed, doc, pos = np.array([5, 9, 5, 7, 9, 5], dtype=np.uint64), np.array([1, 1, 2, 2, 3, 3]), np.array([0, 4, 1, 3, 2, 8])
    got = [np.concatenate(x).tolist() for x in zip(*passages.links(seed, doc, pos))]
    assert sorted(zip(*got)) == [(2, 1, 1, 0), (3, 1, 2, 4), (3, 1, 8, 0)]
    assert list(passages.links(np.array([1, 2, 3], dtype=np.uint64), doc[:3], pos[:3])) == []


def test_whole_reference_parse(spark, corpus):
    """Phrases against all reference documents of the language, run through the document: as the greedy parse by brute force has them."""
    rng, long = random.Random(77), words(90, 400, 30)
    rows = [(i, t, lang) for i, t, lang, _ in corpus if i != 11]
    rows += [(100 + i, " ".join(rng.choice("abc") for _ in range(rng.randint(0, 60))), rng.choice(["en", "fr", None])) for i in range(40)]
    for i in range(30):  # patchworks of pieces, whose matches overlap
        at = [rng.randrange(380) for _ in range(6)]
        rows.append((200 + i, " ".join(w for a in at for w in long[a : a + rng.randint(3, 40)]), "en"))
    rows += [(300, " ".join(long), "en"), (301, " ".join(long).upper(), "en"), (302, "la " * 500, "en"), (303, "la " * 70 + "so", "en"), (303, "La la la so", "en")]
    rows += [(None, " ".join(long[:200]), "en"), (None, " ".join(long[:200]) + " end", "en"), (304, "Été   été un deux", "en"), (305, "été été un", "en"), (300, "twice here", "en")]
    good = {i for i, *_ in rows if i is not None and (i % 3 == 0 or i in (1, 2, 4, 304))}
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = whole_parse_scores(spark, docs, spark.createDataFrame([(i,) for i in sorted(good)] + [(None,)], "doc_id long")).collect()
    assert len(got) == len(rows)
    want = collections.Counter()
    for i, t, lang in rows:
        w, ref = (t or "").lower().split(), [(r or "").lower().split() for j, r, x in rows if j in good and x == lang and j != i]
        m = sum(len((r or "").split()) for j, r, x in rows if j in good and x == lang)
        want[i, len(w), greedy_phrases(w, ref), m] += 1
    assert collections.Counter((r.doc_id, r.n_words, r.n_phrases, r.n_reference) for r in got) == want
    assert all((r.score is None) == (r.n_words == 0) for r in got)
    assert all(abs(r.cross_bits - r.n_phrases * np.log2(max(2, r.n_reference)) / r.n_words) < 1e-9 for r in got if r.n_words)
    assert whole_parse_scores(spark, docs, docs.select("doc_id").limit(0)).count() == len(rows)
    assert whole_parse_scores(spark, docs.limit(0), docs.select("doc_id")).count() == 0


def test_whole_parse_packs_texts_and_forgets_offers(spark, corpus):
    """Chunks travel packed, words have one hash each however long they are, and late rounds hold the offers of open documents only."""
    docs = spark.createDataFrame([(i, "en", True, None, f"{t or ''} {'x' * (i % 700)} Été " * 3) for i, t, _, _ in corpus], "doc_id long, lang string, good boolean, odd long, text string")
    rows = docs.mapInArrow(cross_parse._texter, cross_parse.schema(cross_parse.CHUNK_ROW)).collect()
    assert sum(len(r.text) for r in rows) < sum(r["size"] for r in rows) / 2
    words = {i: (t or "").lower().split() for i, t in docs.select("doc_id", "text").collect()}
    seen, hashes = {}, set()
    for r in rows:
        c = cross_parse.Chunk(r, [])
        for i, a, b in zip(c.ids, c.first[:-1].tolist(), c.first[1:].tolist()):
            assert b - a == len(words[i])
            for w, h in zip(words[i], c.words[a:b].tolist()):
                assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)
    for w in ("a" * n for n in range(1, 600)):
        hashes.update(cross_parse.word_hashes(f"{w} {w} {w[:-1]}b".encode()).tolist())
    assert len(hashes) == 2 * 599
    same = list(range(1, 16))  # two documents in one run of words, a third in another

    def run(row, w):
        at = np.array([0, len(w), *range(len(w) - 7)], "<i4")
        return (row, row, "en", bytearray((1).to_bytes(4, "little") + at.tobytes()), bytearray(np.array(w, "<u8").tobytes()))

    sources = spark.createDataFrame([run(1, same), run(2, same[2:]), run(3, range(50, 65))], "row long, ident long, lang string, at binary, words binary")
    offers = sources.select("row", "lang", "at", "words").mapInArrow(cross_parse._offerer, cross_parse.OFFER)
    fewer, left = cross_parse.narrowed(spark, offers, sources, sources.where("row = 2"))
    assert sorted((r.row, r.p) for r in fewer.collect()) == [(1, p) for p in range(2, 8)] + [(2, p) for p in range(6)]
    assert sorted(r.row for r in left.collect()) == [1, 2]


def test_open_documents_end_the_rounds_together(spark, monkeypatch):
    """Few open documents are parsed at once beside the words of others, as rounds of lookups and the greedy parse by brute force have it."""
    rng, long, asked = random.Random(5), words(91, 420, 60), []
    rows = [(i, " ".join(long[20 * i : 20 * i + 28] + words(900 + i, 5, 60)), "en") for i in range(20)]  # matches end inside the run
    rows += [(30, " ".join(long), "en"), (31, " ".join(long[3:300]), "en"), (31, " ".join(long[100:400]), "en"), (None, " ".join(long[50:200]), "en")]
    rows += [(40 + k, " ".join(w for a in (rng.randrange(380) for _ in range(9)) for w in long[a : a + rng.randint(8, 40)]), "en") for k in range(20)]
    rows += [(70, "la " * 90, "en"), (71, "la " * 40 + "so " + "la " * 30, "en"), (72, " ".join(long[:60]), "fr"), (73, "", "en")]
    good = {*range(0, 20), 31, 41, 44, 47, 70, 71, 72}
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame([(i,) for i in good], "doc_id long")
    want = collections.Counter((i, greedy_phrases(t.split(), [r.split() for j, r, x in rows if j in good and x == lang and j != i])) for i, t, lang in rows)
    keep = cross_parse.stored
    monkeypatch.setattr(cross_parse, "stored", lambda spark, df, name: asked.append(name) or keep(spark, df, name))
    for pairs, together in ((cross_parse.PAIRS, True), (0, False)):
        monkeypatch.setattr(cross_parse, "PAIRS", pairs)
        asked.clear()
        got = whole_parse_scores(spark, docs, marks).collect()
        assert collections.Counter((r.doc_id, r.n_phrases) for r in got) == want
        assert (asked.count("asked") == 1) == together


def test_lengths_beside_the_words_of_others():
    """Lengths of matches are the longest by brute force: up to the end of a stretch, of the document's run, and past many equal words."""
    rng = np.random.default_rng(3)
    mine = rng.integers(0, 2, 900).astype("<u8")
    mine[300:600] = 7
    others = [mine[a : a + n].copy() for a, n in ((0, 40), (5, 300), (250, 400), (290, 40), (310, 200), (640, 8))]
    at = np.arange(len(mine) - 7)
    runs = cross_parse.Runs((1).to_bytes(4, "little") + np.concatenate(([0, len(mine)], at)).astype("<i4").tobytes(), mine.tobytes(), "en")
    ends = np.where(at < 700, 700, len(mine) - 8)
    sent = [(np.array([len(x)], "<i4").tobytes(), x.tobytes()) for x in others[:2]]
    sent.append((np.array([len(x) for x in others[2:]], "<i4").tobytes(), np.concatenate(others[2:]).tobytes()))
    lengths, found = cross_parse.Lengths(runs, ends, sent), 0
    for p in range(0, 700, 7):
        best = 0
        for x in others:
            for q in range(len(x) - 7):
                n = 0
                while n < min(len(x) - q, 708 - p) and x[q + n] == mine[p + n]:
                    n += 1
                best = max(best, n)
        if best >= 8:
            found += 1
            assert lengths[p] == best
    assert found > 50
