"""RDF files: N-Triples and N-Quads natively line by line, Turtle, TriG and JSON-LD file by file."""

import json
import os

import pyarrow as pa
from pyspark.sql import functions as F

from ..functions.names import RDF, XSD
from ..functions.terms import ANY, BNODE, IRI, LIT, STRING, TRIPLE, Val, term
from ..sparql.parser import Parser, SyntaxFault, scan_lines

NODE = r'(?:<[^<>"{}|^`\\\x00-\x20]*>|_:[^\s<>"]+|<<\(.*?\)>>)'
LITERAL = r'"(?:[^"\\]|\\.)*"(?:@[A-Za-z]+(?:-[A-Za-z0-9]+)*(?:--[a-z]+)?|\^\^<[^<>"]*>)?'
LINE = rf"^\s*({NODE})\s+(<[^<>]*>)\s+({NODE}|{LITERAL})\s*({NODE})?\s*\.\s*(?:#.*)?$"
TERM4 = "s struct<kind:int,lex:string,dt:string,lang:string>, p struct<kind:int,lex:string,dt:string,lang:string>, o struct<kind:int,lex:string,dt:string,lang:string>, g struct<kind:int,lex:string,dt:string,lang:string>"
DEFAULT = "urn:quadrille:default"


def unescaped(col):
    """N-Triples escapes resolved by the JSON reader, only where there is a backslash."""
    body = F.replace(col, F.lit("\\'"), F.lit("'"))
    wide = F.regexp_replace(body, r"\\U0000([0-9A-Fa-f]{4})", r"\\u$1")
    return F.when(col.contains("\\"), F.element_at(F.from_json(F.concat(F.lit('["'), wide, F.lit('"]')), "array<string>"), 1)).otherwise(col)


def parse_term(text, scope=None):
    """Term struct column of an N-Triples term text; blank node labels get the scope as prefix."""
    body = F.regexp_extract(text, r'^"((?:[^"\\]|\\.)*)"', 1)
    lang = F.lower(F.regexp_extract(text, r'"@([A-Za-z0-9-]+)$', 1))
    dt = F.regexp_extract(text, r'"\^\^<([^<>]*)>$', 1)
    label = F.substring(text, F.lit(3), F.length(text))
    if scope is not None:
        label = F.concat(scope, F.lit("-"), label)
    return (
        F.when(text.startswith("<<("), term(TRIPLE, text))
        .when(text.startswith("<"), term(IRI, unescaped(F.substring(text, F.lit(2), F.length(text) - 2))))
        .when(text.startswith("_:"), term(BNODE, label))
        .when(text.startswith('"'), term(LIT, unescaped(body), F.when(lang != "", RDF + "langString").when(dt != "", dt).otherwise(STRING), lang))
    )


def read_ntriples(spark, path, strict=True):
    """Quads (s, p, o, g) of N-Triples or N-Quads text; splittable, all in the JVM."""
    lines = spark.read.text(path).withColumn("file", F.input_file_name()).where(~F.col("value").rlike(r"^\s*(#.*)?$"))
    parts = lines.select("file", "value", *[F.regexp_extract("value", LINE, i).alias(n) for i, n in enumerate("spog", 1)])
    if strict:
        ok = F.when(F.col("s") == "", F.raise_error(F.concat(F.lit("not a statement: "), F.col("value")))).otherwise(F.col("s"))
        parts = parts.withColumn("s", ok)
    else:
        parts = parts.where("s <> ''")
    scope = F.hex(F.xxhash64("file"))
    return parts.select(*[parse_term(F.col(n), scope).alias(n) for n in "spo"], F.coalesce(parse_term(F.col("g"), scope), term(IRI, F.lit(DEFAULT))).alias("g"))


class Turtle(Parser):
    """Turtle and TriG documents as quads of term tuples; blank nodes are ("bnode", label)."""

    def __init__(self, text, base=None):
        super().__init__(text, None, base)
        self.quads = []

    def blank(self, label):
        return ("bnode", label)

    def anonymous(self):
        self.fresh += 1
        return ("bnode", f"anon{self.fresh}")

    def verb(self):
        if self.peek() == ("word", "a"):
            self.next()
            return ("iri", RDF + "type")
        return ("iri", self.iri())

    def emit(self, found, graph):
        for s, p, o in found:
            self.quads.append((s, p if p[0] == "iri" else ("iri", p[1]), o, graph))

    def block(self, graph):
        while not self.take_op("}"):
            found = []
            self.triples(found)
            self.emit(found, graph)
            self.take_op(".")
            yield

    def document(self):
        for _ in self.statements():
            pass
        return self.quads

    def statements(self):
        """Parse on, with a stop after every statement."""
        top = ("iri", DEFAULT)
        while self.peek()[0] != "end":
            kind, text = self.peek()
            if (kind, text) in (("lang", "@prefix"), ("lang", "@base")) or self.is_word("PREFIX", "BASE"):
                self.next()
                if text.lower().lstrip("@") == "prefix":
                    name = self.next()[1]
                    self.prefixes[name[:-1]] = self.iri()
                else:
                    self.base = self.iri()
                self.take_op(".")
            elif self.take_word("GRAPH"):
                g = self.term([])
                self.need_op("{")
                yield from self.block(g)
            elif self.take_op("{"):
                yield from self.block(top)
            elif kind in ("iri", "pname", "bnode") and self.peek(1) == ("op", "{"):
                g = self.term([])
                self.next()
                yield from self.block(g)
            else:
                found = []
                self.triples(found)
                self.emit(found, top)
                self.need_op(".")
            yield


class TurtleLines(Turtle):
    """A document that comes line by line: holds the tokens of a statement, not those of the document."""

    def __init__(self, lines, base=None):
        super().__init__("", base)
        self.tokens, self.coming = [], scan_lines(iter(lines))

    def peek(self, ahead=0):
        while len(self.tokens) <= self.at + ahead and (t := next(self.coming, None)):
            self.tokens.append(t)
        return super().peek(ahead)

    def next(self):
        self.peek()
        return super().next()

    def emit(self, found, graph):
        super().emit(found, graph)
        del self.tokens[: self.at]
        self.at = 0


def tuple_struct(t, scope=""):
    """The struct fields of a term tuple."""
    if t[0] == "iri":
        return {"kind": IRI, "lex": t[1], "dt": "", "lang": ""}
    if t[0] == "bnode":
        return {"kind": BNODE, "lex": f"{scope}-{t[1]}" if scope else t[1], "dt": "", "lang": ""}
    if t[0] == "lit":
        return {"kind": LIT, "lex": t[1], "dt": t[2], "lang": t[3] or ""}
    return {"kind": TRIPLE, "lex": "<<( " + " ".join(tuple_text(x) for x in t[1:]) + " )>>", "dt": "", "lang": ""}


def tuple_text(t):
    """N-Triples text of a term tuple."""
    if t[0] == "iri":
        return f"<{t[1]}>"
    if t[0] == "bnode":
        return f"_:{t[1]}"
    if t[0] == "lit":
        body = t[1].replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n").replace("\r", "\\r")
        return f'"{body}"' + (f"@{t[3]}" if t[3] else "" if t[2] == STRING else f"^^<{t[2]}>")
    return "<<( " + " ".join(tuple_text(x) for x in t[1:]) + " )>>"


_STRUCT = pa.struct([("kind", pa.int32()), ("lex", pa.string()), ("dt", pa.string()), ("lang", pa.string())])


def parse_document(text, fmt, base=None):
    """Quads of term tuples of one document; fmt is turtle, trig or jsonld."""
    return JsonLd(json.loads(text), base).quads() if fmt == "jsonld" else Turtle(text, base).document()


def json_items(lines):
    """The items of a JSON document that is an array, one after the other; any other document as the one item."""
    decode, text, more = json.JSONDecoder().raw_decode, "", iter(lines)

    def longer():
        """Twice the text under way at least, so that a long item isn't tried again with every line."""
        nonlocal text
        parts, size = [text], 0
        while size <= len(text) and (x := next(more, None)) is not None:
            parts.append(x)
            size += len(x)
        text = "".join(parts)
        return size > 0

    while not text.lstrip() and longer():
        pass
    text = text.lstrip()
    if not text.startswith("["):
        yield json.loads("".join([text, *more]))
        return
    text, sep = text[1:], ""
    while True:
        text = text.lstrip()
        if not text:
            if not longer():
                raise ValueError("the JSON array doesn't end")
        elif text[0] == "]":
            if (text[1:] + "".join(more)).strip():
                raise ValueError("text after the JSON array")
            return
        elif sep and text[0] != ",":
            raise ValueError(f"expected a comma, found {text[:20]!r}")
        else:
            start = len(text) - len(text[len(sep) :].lstrip())
            try:
                item, end = decode(text, start)
                whole = text[end:].lstrip() != ""  # a number at the end may go on
            except ValueError:
                whole = False
            if whole:
                yield item
                text, sep = text[end:], ","
            elif not longer():
                raise ValueError("the JSON array doesn't end")


def document_parts(lines, fmt, base=None, most=20_000):
    """Lists of quads of a document that comes line by line, most at a time or what one statement has."""
    if fmt == "jsonld":
        reader = JsonLd(None, base)
        out, steps = reader.out, (reader.add(x) for x in json_items(lines))
    else:
        reader = TurtleLines(lines, base)
        out, steps = reader.quads, reader.statements()
    for _ in steps:
        if len(out) >= most:
            yield out[:]
            out.clear()
    if out:
        yield out


def _file_parser(fmt, base):
    def run(batches):
        import hashlib
        from itertools import groupby

        rows = (x for b in batches for x in zip(b.column("path").to_pylist(), b.column("value").to_pylist()))
        for path, own in groupby(rows, lambda x: x[0]):
            scope = hashlib.md5(path.encode()).hexdigest()[:12]
            for quads in document_parts((x[1] + "\n" for x in own), fmt, base):
                for at in range(0, len(quads), 20_000):
                    part = quads[at : at + 20_000]
                    yield pa.RecordBatch.from_arrays([pa.array([tuple_struct(q[i], scope) for q in part], _STRUCT) for i in range(4)], names=list("spog"))

    return run


def read_documents(spark, path, fmt, base=None):
    """Quads of whole files in Turtle, TriG or JSON-LD; a file is one task's work and passes it line by line, in order."""
    lines = spark.read.text(path, lineSep="\n").select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"), "value")
    return lines.repartition("path").sortWithinPartitions("path", "block", "n").select("path", "value").mapInArrow(_file_parser(fmt, base), TERM4)


def quads_from_text(spark, text, fmt="turtle", base=None):
    """Quads DataFrame of one document given as text."""
    rows = [tuple(tuple_struct(t) for t in q) for q in parse_document(text, fmt, base)]
    return spark.createDataFrame(rows, TERM4)


def load(spark, path, fmt=None, base=None):
    """Quads of a file, folder or glob; the format follows the extension unless given."""
    ext = (fmt or os.path.splitext(path.rstrip("/*"))[1].lstrip(".") or "ttl").lower()
    kinds = {"nt": "nt", "nq": "nt", "ntriples": "nt", "nquads": "nt", "trig": "trig", "jsonld": "jsonld", "json": "jsonld"}
    kind = kinds.get(ext, "turtle")
    return read_ntriples(spark, path) if kind == "nt" else read_documents(spark, path, kind, base)


# JSON-LD
class JsonLd:
    """Expansion of JSON-LD 1.1 documents with inline contexts and a static registry; nothing is fetched."""

    REGISTRY = {}

    def __init__(self, doc, base=None):
        self.doc, self.base, self.out, self.n = doc, base, [], 0

    def add(self, item):
        self.top(item, {"@vocab": None, "@base": self.base, "terms": {}}, ("iri", DEFAULT))

    def quads(self):
        self.add(self.doc)
        return self.out

    def fresh(self):
        self.n += 1
        return ("bnode", f"j{self.n}")

    def context(self, ctx, own):
        if own is None:
            return {"@vocab": None, "@base": self.base, "terms": {}}
        for c in own if isinstance(own, list) else [own]:
            if isinstance(c, str):
                if c not in self.REGISTRY:
                    raise SyntaxFault(f"context {c} isn't in the registry")
                c = self.REGISTRY[c].get("@context", {})
            if c is None:
                ctx = {"@vocab": None, "@base": self.base, "terms": {}}
                continue
            ctx = dict(ctx, terms=dict(ctx["terms"]))
            for k in ("@vocab", "@base", "@language"):
                if k in c:
                    ctx[k] = c[k]
            for k, v in c.items():
                if not k.startswith("@"):
                    ctx["terms"][k] = {"@id": v} if isinstance(v, str) or v is None else v
        return ctx

    def iri(self, ctx, text, vocab=False):
        if text is None or text.startswith("@"):
            return text
        if vocab and text in ctx["terms"]:
            to = ctx["terms"][text].get("@id")
            return text if to == text else self.iri(ctx, to, True) if to else ((ctx["@vocab"] or "") + text if "@id" not in ctx["terms"][text] else None)
        if ":" in text:
            prefix, _, rest = text.partition(":")
            if prefix == "_" or rest.startswith("//"):
                return text
            if prefix in ctx["terms"]:
                return self.iri(ctx, ctx["terms"][prefix].get("@id"), True) + rest
            return text
        if vocab:
            return ctx["@vocab"] + text if ctx["@vocab"] else None
        from urllib.parse import urljoin

        return urljoin(ctx["@base"] or "", text)

    def node_term(self, text):
        return ("bnode", text[2:]) if text.startswith("_:") else ("iri", text)

    def top(self, doc, ctx, graph):
        for d in doc if isinstance(doc, list) else [doc]:
            if isinstance(d, dict):
                self.node(d, ctx, graph)

    def keyword(self, ctx, k):
        while k in ctx["terms"] and (ctx["terms"][k].get("@id") or "").startswith("@"):
            k = ctx["terms"][k]["@id"]
        return k

    def node(self, d, ctx, graph):
        """Emit a node object; its term."""
        if "@context" in d:
            ctx = self.context(ctx, d["@context"])
        keys = {self.keyword(ctx, k): k for k in d}
        types = d.get(keys.get("@type", "@type"), [])
        types = types if isinstance(types, list) else [types]
        for t in types:
            scoped = ctx["terms"].get(t, {}).get("@context")
            if scoped:
                ctx = self.context(ctx, scoped)
        me = self.node_term(self.iri(ctx, d[keys["@id"]])) if "@id" in keys else self.fresh()
        for t in types:
            self.out.append((me, ("iri", RDF + "type"), self.node_term(self.iri(ctx, t, True)), graph))
        if "@graph" in keys:
            inner = me if set(keys) - {"@context", "@graph"} else graph
            self.top(d[keys["@graph"]], ctx, inner)
        if "@included" in keys:
            self.top(d[keys["@included"]], ctx, graph)
        if "@nest" in keys:
            for n in [d[keys["@nest"]]] if isinstance(d[keys["@nest"]], dict) else d[keys["@nest"]]:
                for k, v in n.items():
                    self.property(me, k, v, ctx, graph)
        for k, v in (d.get(keys.get("@reverse", "@reverse")) or {}).items():
            for x in v if isinstance(v, list) else [v]:
                self.out.append((self.value(x, ctx, {"@type": "@id"}, graph), ("iri", self.iri(ctx, k, True)), me, graph))
        for k, v in d.items():
            if not self.keyword(ctx, k).startswith("@"):
                self.property(me, k, v, ctx, graph)
        return me

    def property(self, me, k, v, ctx, graph):
        how = ctx["terms"].get(k, {})
        if "@reverse" in how:
            for x in v if isinstance(v, list) else [v]:
                self.out.append((self.value(x, ctx, {"@type": "@id"}, graph), ("iri", self.iri(ctx, how["@reverse"], True)), me, graph))
            return
        if how.get("@id") == "@nest":
            for kk, vv in v.items():
                self.property(me, kk, vv, ctx, graph)
            return
        p = self.iri(ctx, k, True)
        if not p or p.startswith("_:") or ":" not in p:
            return
        if "@context" in how:
            ctx = self.context(ctx, how["@context"])
        box = how.get("@container", [])
        box = box if isinstance(box, list) else [box]
        if how.get("@type") == "@json":
            self.out.append((me, ("iri", p), ("lit", json.dumps(v, separators=(",", ":"), sort_keys=True), RDF + "JSON", None), graph))
            return
        if "@list" in box:
            v = {"@list": v if isinstance(v, list) else [v]}
        if isinstance(v, dict) and "@language" in box:
            v = [{"@value": x, "@language": lang} for lang, xs in v.items() for x in (xs if isinstance(xs, list) else [xs])]
        elif isinstance(v, dict) and "@index" in box:
            v = [x for xs in v.values() for x in (xs if isinstance(xs, list) else [xs])]
        elif isinstance(v, dict) and "@id" in box:
            v = [dict(x, **{"@id": i}) for i, xs in v.items() for x in (xs if isinstance(xs, list) else [xs])]
        elif isinstance(v, dict) and "@type" in box:
            v = [dict(x, **{"@type": t}) if isinstance(x, dict) else {"@id": x, "@type": t} for t, xs in v.items() for x in (xs if isinstance(xs, list) else [xs])]
        for x in v if isinstance(v, list) else [v]:
            if "@graph" in box and isinstance(x, dict):
                g = self.fresh()
                self.out.append((me, ("iri", p), g, graph))
                self.top(x, ctx, g)
                continue
            t = self.value(x, ctx, how, graph)
            if t is not None:
                self.out.append((me, ("iri", p), t, graph))

    def value(self, x, ctx, how, graph):
        kind = how.get("@type")
        if x is None:
            return None
        if isinstance(x, dict):
            keys = {self.keyword(ctx, k): k for k in x}
            if "@value" in keys:
                v, t = x[keys["@value"]], x.get(keys.get("@type", "@type"))
                lang = x.get(keys.get("@language", "@language"))
                if t == "@json":
                    return ("lit", json.dumps(v, separators=(",", ":"), sort_keys=True), RDF + "JSON", None)
                return self.scalar(v, self.iri(ctx, t, True) if t else None, lang)
            if "@list" in keys:
                node = ("iri", RDF + "nil")
                items = x[keys["@list"]]
                for item in reversed(items if isinstance(items, list) else [items]):
                    cell = self.fresh()
                    self.out += [(cell, ("iri", RDF + "first"), self.value(item, ctx, how, graph), graph), (cell, ("iri", RDF + "rest"), node, graph)]
                    node = cell
                return node
            if "@set" in keys:
                return self.value(x[keys["@set"]][0], ctx, how, graph) if x[keys["@set"]] else None
            return self.node(x, ctx, graph)
        if kind in ("@id", "@vocab") and isinstance(x, str):
            return self.node_term(self.iri(ctx, x, kind == "@vocab"))
        lang = how.get("@language", ctx.get("@language")) if kind is None else None
        return self.scalar(x, self.iri(ctx, kind, True) if kind and not kind.startswith("@") else None, lang if isinstance(x, str) else None)

    @staticmethod
    def scalar(v, dt, lang):
        if isinstance(v, bool):
            return ("lit", "true" if v else "false", dt or XSD + "boolean", None)
        if isinstance(v, int):
            return ("lit", str(v), dt or XSD + "integer", None)
        if isinstance(v, float):
            return ("lit", repr(v) if v != int(v) else str(int(v)), dt or XSD + ("double" if v != int(v) else "integer"), None)
        return ("lit", v, RDF + "langString", lang.lower()) if lang else ("lit", v, dt or STRING, None)


# writers
def nt_columns(quads):
    """Quads of term structs as N-Triples texts."""
    return quads.select(*[Val(ANY, F.col(c)).nt().alias(c) for c in quads.columns if c in "spog"])


def nquads_lines(quads):
    """One statement a line; the default graph has no fourth term."""
    t = nt_columns(quads)
    g = F.when(F.col("g") == f"<{DEFAULT}>", F.lit(None).cast("string")).otherwise(F.col("g")) if "g" in t.columns else F.lit(None).cast("string")
    return t.select(F.concat(F.concat_ws(" ", "s", "p", "o", g), F.lit(" .")).alias("value"))


def turtle_lines(quads, graph=DEFAULT):
    """Turtle statements of one graph, a line for each subject."""
    t = nt_columns(quads.where(F.col("g.lex") == graph) if "g" in quads.columns else quads).distinct()
    po = t.groupBy("s", "p").agg(F.sort_array(F.collect_list("o")).alias("os"))
    po = po.select("s", F.concat(F.when(F.col("p") == f"<{RDF}type>", "a").otherwise(F.col("p")), F.lit(" "), F.concat_ws(", ", "os")).alias("po"))
    return po.groupBy("s").agg(F.sort_array(F.collect_list("po")).alias("x")).select(F.concat(F.col("s"), F.lit(" "), F.concat_ws(" ; ", "x"), F.lit(" .")).alias("value"))


def trig_lines(quads):
    """TriG statements: each line a graph block of one subject."""
    t = nt_columns(quads).distinct()
    po = t.groupBy("g", "s", "p").agg(F.sort_array(F.collect_list("o")).alias("os")).select("g", "s", F.concat(F.col("p"), F.lit(" "), F.concat_ws(", ", "os")).alias("po"))
    body = po.groupBy("g", "s").agg(F.sort_array(F.collect_list("po")).alias("x"))
    line = F.concat(F.col("s"), F.lit(" "), F.concat_ws(" ; ", "x"), F.lit(" ."))
    return body.select(F.when(F.col("g") == f"<{DEFAULT}>", line).otherwise(F.concat(F.col("g"), F.lit(" { "), line, F.lit(" }"))).alias("value"))


def jsonld_lines(quads):
    """Flattened JSON-LD node objects, one a line; those of a named graph inside an object of that graph."""
    name = lambda c: F.when(F.col(c)["kind"] == BNODE, F.concat(F.lit("_:"), F.col(c)["lex"])).otherwise(F.col(c)["lex"])
    quote = lambda x: F.to_json(F.array(x))
    inner = lambda x: F.substring(quote(x), F.lit(2), F.length(quote(x)) - 2)
    o = F.col("o")
    value = (
        F.when(o["kind"] != LIT, F.concat(F.lit('{"@id":'), inner(name("o")), F.lit("}")))
        .when(o["lang"] != "", F.concat(F.lit('{"@value":'), inner(o["lex"]), F.lit(',"@language":'), inner(o["lang"]), F.lit("}")))
        .when(o["dt"] == STRING, F.concat(F.lit('{"@value":'), inner(o["lex"]), F.lit("}")))
        .otherwise(F.concat(F.lit('{"@value":'), inner(o["lex"]), F.lit(',"@type":'), inner(o["dt"]), F.lit("}")))
    )
    g = name("g") if "g" in quads.columns else F.lit(DEFAULT)
    t = quads.select(g.alias("g"), name("s").alias("s"), name("p").alias("p"), value.alias("o")).distinct()
    po = t.groupBy("g", "s", "p").agg(F.sort_array(F.collect_list("o")).alias("os")).select("g", "s", F.concat(inner(F.col("p")), F.lit(":["), F.concat_ws(",", "os"), F.lit("]")).alias("po"))
    node = F.concat(F.lit('{"@id":'), inner(F.col("s")), F.lit(","), F.concat_ws(",", "x"), F.lit("}"))
    named = F.concat(F.lit('{"@id":'), inner(F.col("g")), F.lit(',"@graph":['), node, F.lit("]}"))
    return po.groupBy("g", "s").agg(F.sort_array(F.collect_list("po")).alias("x")).select(F.when(F.col("g") == DEFAULT, node).otherwise(named).alias("value"))


def ntriples_lines(quads):
    """Lines of the default graph; a quad of a named graph is an error, because the format has no place for it."""
    if "g" in quads.columns:
        kept = F.when(F.col("g.lex") == DEFAULT, F.col("s")).otherwise(F.raise_error(F.lit("N-Triples can't hold named graphs; write N-Quads or TriG")))
        quads = quads.withColumn("s", kept)
    return nquads_lines(quads)


def save(quads, path, fmt="nq"):
    """Write quads as text files in nt/nq, turtle, trig or jsonld lines."""
    make = {"nt": ntriples_lines, "nq": nquads_lines, "turtle": turtle_lines, "ttl": turtle_lines, "trig": trig_lines, "jsonld": jsonld_lines}[fmt]
    make(quads).write.text(path)
