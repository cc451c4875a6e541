"""OWL 2 Manchester syntax: frames to RDF quads and back.

The reader parses ontology documents (Prefix, Ontology, Import, Annotations, Class, ObjectProperty, DataProperty, Individual,
DisjointClasses, EquivalentClasses, SameIndividual and DifferentIndividuals frames) into the RDF that OWL 2 maps them to,
individuals' types and facts included, so everything that reads quads works on them.  An ontology is a document of
bounded size, so it is parsed by one process; the data it describes stays distributed.

The writer prints quads as frames: named subclass, equivalence and disjointness axioms with their class expressions, property
axioms and individuals with types and facts.
"""

import hashlib
import re

from ..functions.names import OWL, RDF, RDFS, TYPE, XSD
from .rdf import DEFAULT, TERM4, tuple_struct

TOKEN = re.compile(r"""\s+|\#[^\n]*|(?P<iri><[^<>\s]*>)|(?P<str>"(?:[^"\\]|\\.)*"(?:@[A-Za-z-]+|\^\^(?:<[^<>]*>|[\w.-]*:[\w.-]*|\w+))?)|(?P<num>[+-]?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?[fF]?(?![\w:]))|(?P<key>[A-Z][A-Za-z]*:(?=\s|$))|(?P<name>[\w.-]*:[\w.\-/]*|_:\w+|[A-Za-z_][\w.-]*)|(?P<op>[(){}\[\],]|<=|>=|<|>)""")
FRAMES = {"Class:", "ObjectProperty:", "DataProperty:", "AnnotationProperty:", "Datatype:", "Individual:", "Prefix:", "Ontology:", "Import:", "DisjointClasses:", "EquivalentClasses:", "SameIndividual:", "DifferentIndividuals:"}
KINDS = {"Class:": "Class", "ObjectProperty:": "ObjectProperty", "DataProperty:": "DatatypeProperty", "AnnotationProperty:": "AnnotationProperty", "Individual:": "NamedIndividual"}
LINKS = {
    "SubClassOf:": RDFS + "subClassOf", "EquivalentTo:": OWL + "equivalentClass", "DisjointWith:": OWL + "disjointWith", "SubPropertyOf:": RDFS + "subPropertyOf", "Domain:": RDFS + "domain",
    "Range:": RDFS + "range", "InverseOf:": OWL + "inverseOf", "Types:": TYPE, "SameAs:": OWL + "sameAs", "DifferentFrom:": OWL + "differentFrom",
}
CARDINALITY = {"min": "min", "max": "max", "exactly": ""}
BUILTIN = {"integer", "decimal", "float", "double", "string", "boolean", "dateTime", "date"}


class ManchesterFault(ValueError):
    """The text isn't Manchester syntax."""


class Document:
    """Parser of one document; `quads` holds term tuples (s, p, o, g)."""

    def __init__(self, text):
        self.tokens, at = [], 0
        while at < len(text):
            m = TOKEN.match(text, at)
            if not m:
                raise ManchesterFault(f"unexpected {text[at:at + 20]!r}")
            if m.lastgroup:
                self.tokens.append((m.lastgroup, m.group()))
            at = m.end()
        self.at, self.count, self.quads, self.scope = 0, 0, [], hashlib.md5(text.encode()).hexdigest()[:12]
        self.prefixes = {"owl": OWL, "rdf": RDF, "rdfs": RDFS, "xsd": XSD}

    def peek(self):
        return self.tokens[self.at] if self.at < len(self.tokens) else (None, None)

    def next(self):
        t = self.peek()
        self.at += 1
        return t

    def take(self, *words):
        if self.peek()[1] in words:
            return self.next()[1]
        return None

    def need(self, word):
        if not self.take(word):
            raise ManchesterFault(f"expected {word}, found {self.peek()[1]!r}")

    def blank(self):
        self.count += 1
        return ("bnode", f"m{self.count}")

    def emit(self, s, p, o):
        self.quads.append((s, ("iri", p), o, ("iri", DEFAULT)))

    def items(self, node, members):
        """An RDF list; its head, or nil."""
        heads = [self.blank() for _ in members]
        for i, (h, x) in enumerate(zip(heads, members)):
            self.emit(h, RDF + "first", x)
            self.emit(h, RDF + "rest", heads[i + 1] if i + 1 < len(heads) else ("iri", RDF + "nil"))
        self.emit(*node, heads[0] if heads else ("iri", RDF + "nil"))

    def name(self):
        kind, text = self.next()
        if kind == "iri":
            return ("iri", text[1:-1])
        if kind == "name" and text.startswith("_:"):
            return ("bnode", text[2:])
        if kind != "name":
            raise ManchesterFault(f"expected a name, found {text!r}")
        prefix, _, local = text.partition(":") if ":" in text else ("", "", text)
        if ":" not in text and text in BUILTIN and "" not in self.prefixes:
            return ("iri", XSD + text)
        if prefix not in self.prefixes:
            raise ManchesterFault(f"unknown prefix {prefix!r}")
        return ("iri", self.prefixes[prefix] + local)

    def literal(self):
        kind, text = self.next()
        if kind == "num":
            dt = "float" if text[-1] in "fF" else "decimal" if "." in text or "e" in text.lower() else "integer"
            return ("lit", text.rstrip("fF"), XSD + dt, None)
        body, _, rest = text[1:].rpartition('"')
        body = body.replace('\\"', '"').replace("\\\\", "\\")
        if rest.startswith("@"):
            return ("lit", body, RDF + "langString", rest[1:].lower())
        if rest.startswith("^^"):
            name = rest[2:]
            if name.startswith("<"):
                return ("lit", body, name[1:-1], None)
            prefix, _, local = name.rpartition(":")
            return ("lit", body, (self.prefixes[prefix] if prefix in self.prefixes else XSD) + local, None)
        return ("lit", body, XSD + "string", None)

    def value(self):
        kind, text = self.peek()
        if text in ("true", "false"):
            self.next()
            return ("lit", text, XSD + "boolean", None)
        return self.literal() if kind in ("str", "num") else self.name()

    def listed(self, item):
        """Items after each other, commas between; annotations before an item are passed over."""
        out = []
        while True:
            if self.take("Annotations:"):
                self.listed(lambda: (self.name(), self.value()))
            out.append(item())
            if not self.take(","):
                return out

    # class expressions
    def union(self):
        return self.nary("or", OWL + "unionOf", self.intersection)

    def intersection(self):
        return self.nary("and", OWL + "intersectionOf", self.primary, also="that")

    def nary(self, word, link, part, also=None):
        parts = [part()]
        while self.take(word, also or word):
            parts.append(part())
        if len(parts) == 1:
            return parts[0]
        node = self.blank()
        self.emit(node, TYPE, ("iri", OWL + "Class"))
        self.items((node, link), parts)
        return node

    def primary(self):
        if self.take("not"):
            node, inner = self.blank(), self.primary()
            self.emit(node, TYPE, ("iri", OWL + "Class"))
            self.emit(node, OWL + "complementOf", inner)
            return node
        if self.take("("):
            inner = self.union()
            self.need(")")
            return inner
        if self.take("{"):
            members, node = self.listed(self.value), self.blank()
            self.need("}")
            self.emit(node, TYPE, ("iri", OWL + "Class"))
            self.items((node, OWL + "oneOf"), members)
            return node
        inverse = self.take("inverse")
        first = self.name()
        if inverse:
            inner, first = first, self.blank()
            self.emit(first, OWL + "inverseOf", inner)
        word = self.take("some", "only", "value", "Self", "min", "max", "exactly")
        if not word:
            return self.restricted(first)
        node = self.blank()
        self.emit(node, TYPE, ("iri", OWL + "Restriction"))
        self.emit(node, OWL + "onProperty", first)
        if word in ("some", "only"):
            self.emit(node, OWL + ("someValuesFrom" if word == "some" else "allValuesFrom"), self.primary())
        elif word == "value":
            self.emit(node, OWL + "hasValue", self.value())
        elif word == "Self":
            self.emit(node, OWL + "hasSelf", ("lit", "true", XSD + "boolean", None))
        else:
            n = ("lit", self.next()[1], XSD + "nonNegativeInteger", None)
            qualified = self.peek()[0] in ("iri", "name") and self.peek()[1] not in ("and", "or", "that") or self.peek()[1] in ("(", "{")
            kind = ("Qualified" if qualified else "") + "Cardinality"
            self.emit(node, OWL + (CARDINALITY[word] + kind if CARDINALITY[word] else kind[0].lower() + kind[1:]), n)
            if qualified:
                self.emit(node, OWL + "onClass", self.primary())
        return node

    def restricted(self, datatype):
        """A datatype with facets in brackets, or just the name."""
        if not self.take("["):
            return datatype
        node, facets = self.blank(), []
        names = {"<": "maxExclusive", "<=": "maxInclusive", ">": "minExclusive", ">=": "minInclusive"}
        while True:
            op = self.next()[1]
            facet = self.blank()
            self.emit(facet, XSD + names.get(op, op), self.literal())
            facets.append(facet)
            if not self.take(","):
                break
        self.need("]")
        self.emit(node, TYPE, ("iri", RDFS + "Datatype"))
        self.emit(node, OWL + "onDatatype", datatype)
        self.items((node, OWL + "withRestrictions"), facets)
        return node

    # frames
    def parse(self):
        while self.peek()[0]:
            word = self.next()[1]
            if word == "Prefix:":
                prefix = self.next()[1].rstrip(":")
                self.prefixes[prefix] = self.next()[1][1:-1]
            elif word == "Ontology:":
                if self.peek()[0] == "iri" or self.peek()[0] == "name":
                    self.emit(self.name(), TYPE, ("iri", OWL + "Ontology"))
                    if self.peek()[0] == "iri":
                        self.next()
                if self.take("Annotations:"):
                    self.listed(lambda: (self.name(), self.value()))
            elif word == "Import:":
                self.name()
            elif word in KINDS or word == "Datatype:":
                self.frame(word)
            elif word in FRAMES:
                link = {"DisjointClasses:": OWL + "disjointWith", "EquivalentClasses:": OWL + "equivalentClass", "SameIndividual:": OWL + "sameAs", "DifferentIndividuals:": OWL + "differentFrom"}[word]
                members = self.listed(self.union if "Classes" in word else self.name)
                for i, a in enumerate(members):
                    for b in members[i + 1 :]:
                        self.emit(a, link, b)
            else:
                raise ManchesterFault(f"expected a frame, found {word!r}")
        return self.quads

    def frame(self, word):
        me = self.name()
        if word in KINDS:
            self.emit(me, TYPE, ("iri", OWL + KINDS[word]))
        while self.peek()[0] == "key" and self.peek()[1] not in FRAMES:
            part = self.next()[1]
            if part == "Annotations:":
                for p, o in self.listed(lambda: (self.name(), self.value())):
                    self.emit(me, p[1], o)
            elif part == "Facts:":
                for negative, p, o in self.listed(lambda: (self.take("not"), self.name(), self.value())):
                    if negative:
                        node = self.blank()
                        self.emit(node, TYPE, ("iri", OWL + "NegativePropertyAssertion"))
                        for link, x in (("sourceIndividual", me), ("assertionProperty", p), ("targetValue" if o[0] == "lit" else "targetIndividual", o)):
                            self.emit(node, OWL + link, x)
                    else:
                        self.emit(me, p[1], o)
            elif part == "Characteristics:":
                for kind in self.listed(lambda: self.next()[1]):
                    self.emit(me, TYPE, ("iri", OWL + kind + "Property"))
            elif part == "SubPropertyChain:":
                chain = [self.name()]
                while self.take("o"):
                    chain.append(self.name())
                self.items((me, OWL + "propertyChainAxiom"), chain)
            elif part == "DisjointUnionOf:":
                self.items((me, OWL + "disjointUnionOf"), self.listed(self.union))
            elif part in LINKS:
                link = LINKS[part]
                if "Property" in KINDS.get(word, "") and part in ("EquivalentTo:", "DisjointWith:"):
                    link = OWL + {"EquivalentTo:": "equivalentProperty", "DisjointWith:": "propertyDisjointWith"}[part]
                item = self.name if part in ("SubPropertyOf:", "InverseOf:", "SameAs:", "DifferentFrom:") or link.endswith("Property") else self.union
                for o in self.listed(item):
                    if part == "Types:" and o[0] == "bnode":  # an anonymous type gets a name, so that class axioms apply to it
                        self.count += 1
                        named = ("iri", f"urn:quadrille:type:{self.scope}:{self.count}")
                        self.emit(named, RDFS + "subClassOf", o)
                        o = named
                    self.emit(me, link, o)
            else:
                raise ManchesterFault(f"unknown section {part}")


def read_manchester(spark, text):
    """Quads of a Manchester document given as text."""
    rows = [tuple(tuple_struct(t) for t in q) for q in Document(text).parse()]
    return spark.createDataFrame(rows, TERM4)


class Printer:
    """Frames of an ontology's triples (term tuples)."""

    def __init__(self, triples):
        self.po = {}
        for s, p, o in dict.fromkeys(triples):
            self.po.setdefault(s, {}).setdefault(p[1], []).append(o)
        self.negative = {}
        for n in [n for n in self.po if ("iri", OWL + "NegativePropertyAssertion") in self.po[n].get(TYPE, [])]:
            o = self.one(n, OWL + "targetIndividual") or self.one(n, OWL + "targetValue")
            self.negative.setdefault(self.one(n, OWL + "sourceIndividual"), []).append((self.one(n, OWL + "assertionProperty"), o))

    def get(self, s, p):
        return sorted(self.po.get(s, {}).get(p, []), key=str)

    def one(self, s, p):
        return next(iter(self.get(s, p)), None)

    def members(self, node):
        out = []
        while node and node != ("iri", RDF + "nil"):
            out.append(self.one(node, RDF + "first"))
            node = self.one(node, RDF + "rest")
        return out

    @staticmethod
    def word(t):
        if t[0] == "lit":
            body = t[1].replace("\\", "\\\\").replace('"', '\\"')
            return f'"{body}"' + (f"@{t[3]}" if t[3] else "" if t[2] == XSD + "string" else f"^^<{t[2]}>")
        return f"<{t[1]}>" if t[0] == "iri" else f"_:{t[1]}"

    def expression(self, t):
        if t[0] != "bnode":
            return self.word(t)
        for link, word in ((OWL + "intersectionOf", " and "), (OWL + "unionOf", " or ")):
            if head := self.one(t, link):
                return "(" + word.join(self.expression(x) for x in self.members(head)) + ")"
        if inner := self.one(t, OWL + "complementOf"):
            return f"not {self.expression(inner)}"
        if head := self.one(t, OWL + "oneOf"):
            return "{" + ", ".join(self.word(x) for x in self.members(head)) + "}"
        if p := self.one(t, OWL + "onProperty"):
            p = self.word(p) if p[0] == "iri" else f"inverse {self.word(self.one(p, OWL + 'inverseOf'))}"
            for link, word in (("someValuesFrom", "some"), ("allValuesFrom", "only")):
                if x := self.one(t, OWL + link):
                    return f"({p} {word} {self.expression(x)})"
            if x := self.one(t, OWL + "hasValue"):
                return f"({p} value {self.word(x)})"
            if self.one(t, OWL + "hasSelf"):
                return f"({p} Self)"
            for link, word in (("min", "min"), ("max", "max"), ("", "exactly")):
                for kind in ("Cardinality", "QualifiedCardinality"):
                    name = link + kind if link else kind[0].lower() + kind[1:]
                    if n := self.one(t, OWL + name):
                        c = self.one(t, OWL + "onClass")
                        return f"({p} {word} {n[1]}{' ' + self.expression(c) if c else ''})"
        if base := self.one(t, OWL + "onDatatype"):
            short = {"maxExclusive": "<", "maxInclusive": "<=", "minExclusive": ">", "minInclusive": ">="}
            facets = [(p.removeprefix(XSD), os[0]) for f in self.members(self.one(t, OWL + "withRestrictions")) for p, os in self.po[f].items()]
            return self.word(base) + "[" + ", ".join(f"{short.get(p, p)} {self.word(o)}" for p, o in facets) + "]"
        return self.word(t)

    def text(self):
        """The frames, by name."""
        lines, done, header = [], {TYPE}, ""
        kinds = {v: k for k, v in KINDS.items()}
        for s in sorted((s for s in self.po if s[0] == "iri"), key=str):
            types = self.get(s, TYPE)
            if ("iri", OWL + "Ontology") in types:
                header = f" {self.word(s)}"
                continue
            frame = next((kinds[t[1].removeprefix(OWL)] for t in types if t[1].removeprefix(OWL) in kinds and t[1].startswith(OWL)), None)
            if frame is None:
                frame = "Class:" if self.get(s, RDFS + "subClassOf") or self.get(s, OWL + "equivalentClass") or self.get(s, OWL + "disjointWith") else "Individual:"
            lines.append(f"{frame} {self.word(s)}")
            own = {v: k for k, v in LINKS.items() if v not in done} | {OWL + "equivalentProperty": "EquivalentTo:", OWL + "propertyDisjointWith": "DisjointWith:"}
            for p in sorted(self.po[s]):
                os = self.get(s, p)
                if p == TYPE:
                    marks = [t[1].removeprefix(OWL).removesuffix("Property") for t in os if t[0] == "iri" and t[1].startswith(OWL) and t[1].endswith("Property") and t[1].removeprefix(OWL) not in KINDS.values()]
                    rest = [t for t in os if not (t[0] == "iri" and t[1].startswith(OWL) and t[1] != OWL + "Thing")]
                    if marks and frame.endswith("Property:"):
                        lines.append("    Characteristics: " + ", ".join(marks))
                    if rest and frame == "Individual:":
                        lines.append("    Types: " + ", ".join(self.expression(t) for t in rest))
                elif p == OWL + "propertyChainAxiom":
                    lines += ["    SubPropertyChain: " + " o ".join(self.word(x) for x in self.members(o)) for o in os]
                elif p in own:
                    lines.append(f"    {own[p]} " + ", ".join(self.expression(o) for o in os))
                elif frame == "Individual:":
                    lines.append("    Facts: " + ", ".join(f"<{p}> {self.word(o)}" for o in os))
                else:
                    lines.append("    Annotations: " + ", ".join(f"<{p}> {self.word(o)}" for o in os))
            lines += [f"    Facts: not {self.word(p)} {self.word(o)}" for p, o in sorted(self.negative.get(s, []), key=str)]
        return f"Ontology:{header}\n" + "\n".join(lines) + "\n"


def manchester_text(quads, most=1_000_000):
    """Manchester document of an ontology's quads; more than `most` quads are data and are refused."""
    rows = quads.select("s", "p", "o").distinct().limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError("too many quads for one document")
    tup = lambda t: ("iri", t.lex) if t.kind == 1 else ("bnode", t.lex) if t.kind == 2 else ("lit", t.lex, t.dt, t.lang or None)
    return Printer([(tup(r.s), tup(r.p), tup(r.o)) for r in rows]).text()


__all__ = ["Document", "ManchesterFault", "manchester_text", "read_manchester"]
