"""OWL 2 RL entailment: ontology triples to Datalog rules, sameAs by connected components.

Axioms are read from the source on the driver (an ontology is small next to the data); property and class axioms become
rules whose shapes the Datalog engine joins as tables.
"""

from pyspark.sql import functions as F

from ..functions.names import OWL, RDF, RDFS, TYPE
from ..functions.terms import Val
from ..plans.fixpoint import components
from ..plans.store import materialise
from ..sources.quads import QuadSource
from .datalog import KEY, TOP, Rule, materialise_rules

STRUCTURE = [RDFS + x for x in ("subClassOf", "subPropertyOf", "domain", "range")] + [OWL + x for x in ("equivalentClass", "equivalentProperty", "inverseOf", "propertyChainAxiom", "disjointWith", "intersectionOf", "unionOf", "complementOf", "someValuesFrom", "allValuesFrom", "onProperty", "hasValue", "maxCardinality", "maxQualifiedCardinality", "minQualifiedCardinality", "onClass", "propertyDisjointWith")] + [RDF + "first", RDF + "rest"]
KINDS = [OWL + x for x in ("TransitiveProperty", "SymmetricProperty", "FunctionalProperty", "InverseFunctionalProperty", "AsymmetricProperty", "IrreflexiveProperty", "Class", "Restriction")]
X, Y, Z = ("var", "x"), ("var", "y"), ("var", "z")


def _atom(s, p, o):
    return (s, p if isinstance(p, tuple) else ("iri", p), o, TOP)


def _type(x, c):
    return (x, ("iri", TYPE), ("iri", c), TOP)


class Ontology:
    """Axiom triples by subject and predicate, as term tuples."""

    def __init__(self, triples):
        self.po, self.triples = {}, triples
        for s, p, o in triples:
            self.po.setdefault(s, {}).setdefault(p[1], []).append(o)

    @staticmethod
    def from_source(source, most=5_000_000):
        ids = lambda names: [Val.const(("iri", x)).id() for x in names]
        want = F.col("p").isin(*ids(STRUCTURE)) | ((F.col("p") == ids([TYPE])[0]) & F.col("o").isin(*ids(KINDS)))
        rows = QuadSource(source.spark, source.quads.where(want), source.terms).as_terms().limit(most + 1).collect()
        if len(rows) > most:
            raise ValueError("the ontology has too many axioms for the driver")
        tup = lambda t: ("iri", t.lex) if t.kind == 1 else ("bnode", t.lex) if t.kind == 2 else ("lit", t.lex, t.dt, t.lang or None)
        return Ontology([(tup(r.s), tup(r.p), tup(r.o)) for r in rows])

    def get(self, s, p):
        return self.po.get(s, {}).get(p, [])

    def items(self, node):
        out = []
        while node != ("iri", RDF + "nil") and node is not None:
            out += self.get(node, RDF + "first")
            node = next(iter(self.get(node, RDF + "rest")), None)
        return out

    def sub_bodies(self, c, x, fresh, defined=False):
        """Bodies (lists of atoms) under which x is in the class expression c, for the subclass side; None if not expressible.

        A named class stands for itself, with `defined` for what it is defined as.
        """
        if c[0] == "iri" and not defined:
            return [[]] if c[1] == OWL + "Thing" else [[_type(x, c[1])]]
        if lst := self.get(c, OWL + "intersectionOf"):
            out = [[]]
            for part in self.items(lst[0]):
                bodies = self.sub_bodies(part, x, fresh)
                if bodies is None:
                    return None
                out = [a + b for a in out for b in bodies]
            return out
        if lst := self.get(c, OWL + "unionOf"):
            parts = [self.sub_bodies(p, x, fresh) for p in self.items(lst[0])]
            return None if None in parts else [b for p in parts for b in p]
        prop = next(iter(self.get(c, OWL + "onProperty")), None)
        if prop and (v := self.get(c, OWL + "hasValue")):
            return [[self.role(prop, x, v[0])]]
        filler = self.get(c, OWL + "someValuesFrom")
        if not filler and any(n[1] == "1" for n in self.get(c, OWL + "minQualifiedCardinality")):
            filler = self.get(c, OWL + "onClass")
        if prop and filler:
            y = fresh()
            inner = self.sub_bodies(filler[0], y, fresh)
            return None if inner is None else [[self.role(prop, x, y), *b] for b in inner]
        return None

    def role(self, prop, x, y):
        inverse = self.get(prop, OWL + "inverseOf") if prop[0] == "bnode" else []
        return _atom(y, inverse[0], x) if inverse else _atom(x, prop, y)

    def super_rules(self, c, x, body, fresh):
        """Rules that put x, under a body, into the class expression c."""
        pos = tuple(("pos", a) for a in body)
        if c[0] == "iri":
            return [Rule(_type(x, c[1]), pos)] if pos else []
        out = []
        if lst := self.get(c, OWL + "intersectionOf"):
            for part in self.items(lst[0]):
                out += self.super_rules(part, x, body, fresh)
        if other := self.get(c, OWL + "complementOf"):
            for b in self.sub_bodies(other[0], x, fresh) or []:
                out.append(Rule(None, pos + tuple(("pos", a) for a in b)))
        prop = next(iter(self.get(c, OWL + "onProperty")), None)
        if prop:
            for v in self.get(c, OWL + "hasValue"):
                out.append(Rule(self.role(prop, x, v), pos))
            for filler in self.get(c, OWL + "allValuesFrom"):
                y = fresh()
                out += self.super_rules(filler, y, [*body, self.role(prop, x, y)], fresh)
            for kind in ("maxCardinality", "maxQualifiedCardinality"):
                for n in self.get(c, OWL + kind):
                    of = self.get(c, OWL + "onClass")
                    y, z = fresh(), fresh()
                    extra = lambda v, of=of: [("pos", _type(v, of[0][1]))] if of and of[0][0] == "iri" and of[0][1] != OWL + "Thing" else []
                    if n[1] == "0":
                        out.append(Rule(None, (*pos, ("pos", self.role(prop, x, y)), *extra(y))))
                    if n[1] == "1":
                        out.append(Rule(_atom(y, OWL + "sameAs", z), (*pos, ("pos", self.role(prop, x, y)), ("pos", self.role(prop, x, z)), *extra(y), *extra(z), ("neq", y, z))))
        return out

    def rules(self, extensions=True):
        """All Datalog rules of the ontology; extensions adds inverses, (inverse-)functional and disjoint properties."""
        out, n = [], [0]

        def fresh():
            n[0] += 1
            return ("var", f"v{n[0]}")

        def sub(c, d):
            bodies = self.sub_bodies(c, X, fresh)
            for b in bodies or []:
                out.extend(self.super_rules(d, X, b, fresh))

        for s, p, o in self.triples:
            name = p[1]
            if name == RDFS + "subClassOf":
                sub(s, o)
            elif name == OWL + "equivalentClass":
                sub(s, o)
                sub(o, s)
            elif name in (OWL + "intersectionOf", OWL + "unionOf") and s[0] == "iri":
                for b in self.sub_bodies(s, X, fresh, defined=True) or []:
                    out.append(Rule(_type(X, s[1]), tuple(("pos", a) for a in b)))
                for part in self.items(o) if name == OWL + "intersectionOf" else []:
                    out.extend(self.super_rules(part, X, [_type(X, s[1])], fresh))
            elif name == OWL + "disjointWith":
                for a in self.sub_bodies(s, X, fresh) or []:
                    for b in self.sub_bodies(o, X, fresh) or []:
                        out.append(Rule(None, tuple(("pos", t) for t in a + b)))
            elif name == RDFS + "subPropertyOf":
                out.append(Rule(_atom(X, o, Y), (("pos", self.role(s, X, Y)),)))
            elif name == OWL + "equivalentProperty":
                out += [Rule(_atom(X, o, Y), (("pos", _atom(X, s, Y)),)), Rule(_atom(X, s, Y), (("pos", _atom(X, o, Y)),))]
            elif name == RDFS + "domain":
                out += self.super_rules(o, X, [_atom(X, s, Y)], fresh)
            elif name == RDFS + "range":
                out += self.super_rules(o, Y, [_atom(X, s, Y)], fresh)
            elif name == OWL + "propertyChainAxiom":
                at, body = X, []
                for q in self.items(o):
                    nxt = fresh()
                    body.append(("pos", self.role(q, at, nxt)))
                    at = nxt
                out.append(Rule(_atom(X, s, at), tuple(body)))
            elif name == OWL + "inverseOf" and s[0] == "iri" and extensions:
                out += [Rule(_atom(Y, o, X), (("pos", _atom(X, s, Y)),)), Rule(_atom(Y, s, X), (("pos", _atom(X, o, Y)),))]
            elif name == OWL + "propertyDisjointWith" and extensions:
                out.append(Rule(None, (("pos", _atom(X, s, Y)), ("pos", _atom(X, o, Y)))))
            elif name == TYPE:
                k = o[1]
                if k == OWL + "TransitiveProperty":
                    out.append(Rule(_atom(X, s, Z), (("pos", _atom(X, s, Y)), ("pos", _atom(Y, s, Z)))))
                elif k == OWL + "SymmetricProperty":
                    out.append(Rule(_atom(Y, s, X), (("pos", _atom(X, s, Y)),)))
                elif k == OWL + "FunctionalProperty" and extensions:
                    out.append(Rule(_atom(Y, OWL + "sameAs", Z), (("pos", _atom(X, s, Y)), ("pos", _atom(X, s, Z)), ("neq", Y, Z))))
                elif k == OWL + "InverseFunctionalProperty" and extensions:
                    out.append(Rule(_atom(Y, OWL + "sameAs", Z), (("pos", _atom(Y, s, X)), ("pos", _atom(Z, s, X)), ("neq", Y, Z))))
                elif k == OWL + "IrreflexiveProperty" and extensions:
                    out.append(Rule(None, (("pos", _atom(X, s, X)),)))
                elif k == OWL + "AsymmetricProperty" and extensions:
                    out.append(Rule(None, (("pos", _atom(X, s, Y)), ("pos", _atom(Y, s, X)))))
        return list(dict.fromkeys(r for r in out if r.head is None or all(t[0] != "bnode" for t in r.head)))


def same_as_classes(source):
    """Representative (smallest id) of every resource in an owl:sameAs pair: rows (id, rep)."""
    return components(same_pairs(source))


def same_pairs(source):
    pairs = source.pattern(("var", "a"), ("iri", OWL + "sameAs"), ("var", "b"))
    return pairs.df.select(pairs.val("a").col.alias("a"), pairs.val("b").col.alias("b"))


def merge_same(source, classes=None):
    """The source with sameAs resources replaced by their representative in subject and object position."""
    classes = materialise(same_as_classes(source), "classes") if classes is None else classes
    q = source.quads
    for c in "so":
        q = q.join(classes.select(F.col("id").alias(c), F.col("rep").alias("r")), c, "left").withColumn(c, F.coalesce("r", c)).drop("r")
    q = q.groupBy(*KEY).agg(F.min("derived").alias("derived"))
    return QuadSource(source.spark, materialise(q, "merged"), source.terms), classes


def expand_same(source, classes):
    """Undo merge_same: every member of a class takes part in its representative's quads, and sameAs holds within classes."""
    q = source.quads
    for c in "so":
        members = classes.select(F.col("rep").alias(c), F.col("id").alias("m"))
        q = q.join(members, c, "left").withColumn(c, F.coalesce("m", c)).drop("m")
    return QuadSource(source.spark, materialise(q.groupBy(*KEY).agg(F.min("derived").alias("derived")), "expanded"), source.terms)


def entail(source, ontology=None, extensions=True, max_merges=20):
    """A source with everything OWL 2 RL derives.

    Where there are equalities, resources are replaced by their class's representative, the rules run again and so on
    until no new equality appears; only then, once, every member of a class gets its representative's quads.
    """
    rules = (ontology or Ontology.from_source(source)).rules(extensions)
    out = materialise_rules(source, rules)
    if same_pairs(out).where("a <> b").isEmpty():
        return out
    classes = materialise(same_as_classes(out), "classes")
    for _ in range(max_merges):
        merged, _ = merge_same(out, classes)
        out = materialise_rules(merged, rules)
        fresh = same_pairs(out).where("a <> b")
        if fresh.isEmpty():
            return expand_same(out, classes)
        classes = materialise(components(fresh.unionByName(classes.select(F.col("id").alias("a"), F.col("rep").alias("b")))), "classes")
    raise RuntimeError("equalities didn't settle")


def inconsistent(source):
    """Members of owl:Nothing."""
    return source.pattern(("var", "x"), ("iri", TYPE), ("iri", OWL + "Nothing"))


__all__ = ["Ontology", "entail", "expand_same", "inconsistent", "merge_same", "same_as_classes"]
