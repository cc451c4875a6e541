"""Main text of web pages by tag-path ratios.

A page becomes a sequence of text blocks, each with its root-to-leaf tag path.  Text length and punctuation are
aggregated per path and divided by the number of blocks on it; the two ratios are fused.  They select twice.  Smoothed over
neighbouring blocks and thresholded against the page they choose the content node: the deepest element that holds
nearly all of the weight that passed, or the heaviest of the page's article and main elements.  Inside it a path is
dropped whose ratio is far below that of the node's text: counters, buttons and stray labels, short and without
punctuation, that no paragraph, heading, list or table cell holds, and, outside of article and main, lists of nothing but links.

Marked boilerplate goes besides: menus, headers, footers, sidebars, notices, adverts, forms, reader comments, scripts and styles.
Class names and ids are a prior only.  They count as a whole, or by their parts (`ad-slot`) on elements of little weight, and
never on an element that holds most of the page's weight or its main element, as a form doesn't there; reader comments may
hold most of a page as long as there is other text.

Defined cases: null, empty or text-free html gives an empty text; html without tags is one block; unclosed and stray
tags are tolerated as browsers do; truncated pages end where they end; repeated rows give repeated results; extra
columns are ignored; an empty table gives an empty result.  Character references are
decoded, white space inside a block becomes one space, blocks are joined by one newline.
"""

import html as _html
import math
import re

import pyarrow as pa
from pyspark.sql import functions as F

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*'|[\"'])*+)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"(?i)\b(class|id|role|hidden|aria-hidden|style)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)")
RAW = {"script", "style", "textarea", "title", "template", "iframe", "svg", "select", "option", "canvas", "audio", "video"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "br", "math", "mi", "mn", "mo", "ms", "mtext", "mrow", "msup", "msub", "msubsup", "mfrac", "msqrt", "mroot", "mover", "munder", "munderover"}
BOILERPLATE = {"nav", "footer", "aside", "header", "menu", "dialog", "button", "head"} | RAW
WORDS = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "banner", "cookie", "cookies", "consent", "gdpr", "notice", "notices", "popup", "modal", "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "sidebar", "side", "aside", "footer", "header", "masthead", "comment", "comments", "disqus", "respond", "replies", "related", "share", "sharing", "social", "subscribe", "newsletter", "signup", "login", "search", "widget", "toolbar", "pagination", "pager", "skip"}
LOOSE = {"related", "search", "share", "sharing", "side", "skip", "social", "toolbar", "widget"}  # boilerplate only outside of main and article
SLIGHT = {"ad", "ads", "advert", "adverts", "advertisement", "sponsored", "promo", "cookie", "consent", "gdpr", "newsletter"}  # parts of names that count inside of main and article too
READERS = {"comment", "comments", "disqus", "respond", "replies"}
TEXT_TAGS = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dt", "dd", "td", "th", "blockquote", "pre", "figcaption", "caption", "summary", "address"}
PARTS, QUOTED, HIDDEN = re.compile(r"[-_]+"), re.compile(r"\"[^\"]*\"|'[^']*'"), re.compile(r"(?i)(?:^|\s)hidden(?=[\s/=]|$)")
FAINT, LABEL = 0.05, 40  # share of the typical ratio under which a path is no text, and characters a block under which it may be labels
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "menu", "menubar"}
CLOSES_P = {"address", "article", "aside", "blockquote", "center", "details", "dialog", "dir", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul"}
PUNCT = re.compile(r"[.,;:!?。，、！？¿¡…]")
ENDS = {t: re.compile(rf"</{t}\b[^>]*(?:>|\Z)", re.I) for t in RAW}


class Node:
    __slots__ = ("tag", "path", "parent", "junk", "named", "readers", "main", "inside", "weight", "depth")

    def __init__(self, tag, parent, mark="", junk=False, main=False, named=0.0, readers=False):
        """named is the share of the page's weight up to which the element's name marks boilerplate, 0 where it doesn't."""
        self.tag, self.parent = tag, parent
        self.path = (parent.path if parent else "") + "/" + tag + mark
        self.junk = junk or bool(parent and parent.junk)
        self.main, self.named, self.readers, self.inside = main, named, readers, main or bool(parent and parent.inside)
        self.weight, self.depth = 0.0, parent.depth + 1 if parent else 0


def blocks(page):
    """The page's text blocks in order: (node, text, characters of it in links)."""
    out, parts, linked, link = [], [], 0, 0
    root = node = Node("", None)
    at = scan = 0

    def flush():
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            parts.clear()
            if text:
                out.append((node, text, min(linked, len(text))))
        linked = 0

    def up(tag, stop=()):
        """The nearest open ancestor with this tag, unless one in stop is nearer."""
        n = node
        while n is not root:
            if n.tag == tag:
                return n
            if n.tag in stop:
                return None
            n = n.parent
        return None

    while m := TOKEN.search(page, scan):
        if m.start() > at:
            raw = page[at : m.start()]
            parts.append(_html.unescape(raw) if "&" in raw else raw)
            if link:
                linked += len(" ".join(parts[-1].split()))
        at = scan = m.end()
        tag = m.group(2)
        if tag is None:
            continue
        tag = tag.lower()
        if m.group(1):
            if tag in INLINE:
                if tag == "a":
                    link = 0
                continue
            flush()
            found = up(tag, ("table",) if tag != "table" else ())
            if found:
                node = found.parent
            continue
        if tag in INLINE:
            if tag == "br":
                parts.append(" ")
            elif tag == "a":
                link = 1
            continue
        flush()
        if tag in RAW:
            end = ENDS[tag].search(page, at)  # what stands before the end tag is not markup
            at = scan = end.end() if end else len(page)
            continue
        if tag in VOID:
            continue
        if tag in CLOSES_P and (p := up("p", ("button", "td", "th", "caption", "object"))):
            node = p.parent
        if tag in ("li", "dt", "dd", "tr", "td", "th", "option") and (p := up(tag, ("ul", "ol", "dl", "table"))):
            node = p.parent
        attrs, mark, junk, main = m.group(3), "", tag in BOILERPLATE, tag in ("article", "main")
        inside = node.inside
        named = 0.5 if tag == "form" or tag == "noscript" and not inside else 0.0
        readers = False
        if tag == "header" and up("article"):
            junk = False
        if attrs and ("=" in attrs or HIDDEN.search(attrs)):
            found = {k.lower(): v.strip("\"'").lower() for k, v in ATTRIBUTE.findall(attrs)}
            names = found.get("class", "") + " " + found.get("id", "")
            words = set(names.split())
            mark = "." + ".".join(names.split()) if names.strip() else ""
            junk = junk or bool(HIDDEN.search(QUOTED.sub("", attrs)))
            if tag not in ("html", "body", "article", "main"):
                pieces = {x for w in words for x in PARTS.split(w)}
                if readers := bool(words & READERS):
                    named = 2.0
                elif words & (WORDS - LOOSE if inside else WORDS):
                    named = 0.5
                elif pieces & READERS:
                    named, readers = 0.8, True
                elif pieces & (SLIGHT if inside else WORDS):
                    named = max(named, 0.25)
                junk = junk or found.get("role") in ROLES or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "")
            elif tag == "article" and words & {"comment", "comments", "reply"}:
                junk = True
            main = main or found.get("role") in ("main", "article") or found.get("itemprop") == "articlebody"
        node = Node(tag, node, mark, junk, main, named, readers)
    if at < len(page):
        raw = page[at:]
        parts.append(_html.unescape(raw) if "&" in raw else raw)
        if link:
            linked += len(" ".join(parts[-1].split()))
    flush()
    return out


def path_ratios(texts, paths):
    """Per block the text length and the punctuation of its path, both per block on the path."""
    total, marks, count = {}, {}, {}
    for t, p in zip(texts, paths):
        total[p] = total.get(p, 0) + len(t)
        marks[p] = marks.get(p, 0) + len(PUNCT.findall(t))
        count[p] = count.get(p, 0) + 1
    return [total[p] / count[p] for p in paths], [marks[p] / count[p] for p in paths]


def path_scores(texts, paths, sigma=1.0, reach=2):
    """Fused ratio per block: smoothed text length per block of its path times smoothed punctuation per block."""
    size, punct = path_ratios(texts, paths)
    kernel = [math.exp(-d * d / (2 * sigma * sigma)) for d in range(reach + 1)]

    def smooth(x):
        out = []
        for i in range(len(x)):
            lo, hi = max(0, i - reach), min(len(x), i + reach + 1)
            w = [kernel[abs(i - j)] for j in range(lo, hi)]
            out.append(sum(a * b for a, b in zip(w, x[lo:hi])) / sum(w))
        return out

    return [a * (1 + b) for a, b in zip(smooth(size), smooth(punct))]


def lineage(node):
    while node is not None:
        yield node
        node = node.parent


def without_named(found):
    """The blocks but for those in elements that a name or a form marks as boilerplate.

    The mark doesn't count on an element that holds more of the page's fused weight than it allows, nor on one that holds
    the heaviest main element where no main element is outside of marked ones, nor on all there is.
    """
    if not any(n.named for node, *_ in found for n in lineage(node)):
        return found
    weights, scores = {}, path_scores([t for _, t, _ in found], [n.path for n, *_ in found])
    for (node, t, _), s in zip(found, scores):
        for n in lineage(node):
            weights[n] = weights.get(n, 0.0) + s * len(t)
    everything = max(weights.values())
    for n in weights:
        if n.named and weights[n] > n.named * everything and (n.named != 0.5 or n.tag == "form" or not any(u.main for u in lineage(n))):
            n.named = 0.0
    mains = [n for n in weights if n.main]
    if mains and all(any(u.named for u in lineage(n)) for n in mains):
        for n in lineage(max(mains, key=weights.get)):
            n.named = 0.0
    kept = [x for x in found if not any(n.named for n in lineage(x[0]))]
    return kept or [x for x in found if not any(n.named and not n.readers for n in lineage(x[0]))]


def selected(inside):
    """The blocks of the content node without those on paths whose ratio is far below that of its text."""
    size, punct = path_ratios([t for _, t, _ in inside], [n.path for n, *_ in inside])
    ratio = [a * (1 + b) for a, b in zip(size, punct)]
    typical = sum(r * len(t) for r, (_, t, _) in zip(ratio, inside)) / sum(len(t) for _, t, _ in inside)
    chars, linked = {}, {}
    for n, t, a in inside:
        chars[n.path] = chars.get(n.path, 0) + len(t)
        linked[n.path] = linked.get(n.path, 0) + a
    keep = []
    for (n, t, _), r, length, marks in zip(inside, ratio, size, punct):
        links = not n.inside and n.tag != "p" and marks < 1 and linked[n.path] >= 0.9 * chars[n.path]
        stray = n.tag not in TEXT_TAGS and not any(u.tag in TEXT_TAGS for u in lineage(n)) and marks < 1 and length < LABEL
        if r >= FAINT * typical and not (links and r < 0.5 * typical) or not (links or stray):
            keep.append(t)
    return keep


def main_text(page):
    """The page's main text, blocks joined by newlines."""
    if not page:
        return ""
    found = [x for x in blocks(page) if not x[0].junk]
    if not found:
        return ""
    found = without_named(found)
    if not found:
        return ""
    scores = path_scores([t for _, t, _ in found], [n.path for n, *_ in found])
    level = sum(scores) / len(scores) * 0.5  # paths whose fused ratio reaches half of the page's mean carry content
    for (n, t, _), s in zip(found, scores):
        weight = s * len(t) if s >= level else 0.0
        for up in lineage(n):
            up.weight += weight
    everything, best, marked = 0.0, None, []
    for n, *_ in found:
        for up in lineage(n):
            everything = max(everything, up.weight)
    marked = list(dict.fromkeys(top for n, *_ in found if (top := next((u for u in reversed(list(lineage(n))) if u.main), None))))
    if marked:
        best = max(marked, key=lambda n: n.weight)
    else:
        for n, *_ in found:
            for up in lineage(n):
                if up.tag not in ("p", "li", "h1", "h2", "h3", "h4", "h5", "h6", "td", "tr") and up.weight >= 0.9 * everything and (best is None or up.depth > best.depth):
                    best = up
    inside = [x for x in found if best is None or any(u is best for u in lineage(x[0]))]
    return "\n".join(selected(inside))


def _extract(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, 200):
            part = batch.slice(at, 200)
            texts = [main_text(x) for x in part.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def main_texts(spark, pages):
    """Main text of every row of pages(page_id, url, html): (page_id, url, text, n_chars)."""
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return pages.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
