"""SHACL validation: shapes from a graph, constraints as joins and aggregations over all focus nodes at once.

The report is a DataFrame (focus, path, value, component, shape, severity, message).
"""

from functools import reduce

from pyspark.sql import functions as F

from ..functions.names import RDFS, SH, TYPE
from ..functions.scalar import CASTS, cast, equal, less
from ..functions.terms import ANY, BNODE, ID, IRI, LIT, STRING, Val
from ..plans import plan as P
from ..plans.plan import Plan, columns
from ..plans.store import materialise, spread
from ..sparql.compile import Compiler
from ..sparql.parser import parse_query
from .owl import Ontology

KINDS = {SH + "IRI": {IRI}, SH + "BlankNode": {BNODE}, SH + "Literal": {LIT}, SH + "BlankNodeOrIRI": {IRI, BNODE}, SH + "IRIOrLiteral": {IRI, LIT}, SH + "BlankNodeOrLiteral": {BNODE, LIT}}
REPORT = ["focus", "path", "value", "component", "shape", "severity", "message"]


class Shapes(Ontology):
    """A shapes graph as term tuples."""

    @staticmethod
    def from_text(text, fmt="turtle"):
        from ..sources.rdf import parse_document

        return Shapes([q[:3] for q in parse_document(text, fmt)])

    def one(self, s, name, default=None):
        return next(iter(self.get(s, SH + name)), default)

    def roots(self):
        """Shapes with targets."""
        out = []
        for s in self.po:
            t = self.po[s]
            implicit = any(k in t.get(TYPE, []) for k in [("iri", RDFS + "Class"), ("iri", "http://www.w3.org/2002/07/owl#Class")]) and any(("iri", SH + k) in t.get(TYPE, []) for k in ("NodeShape", "PropertyShape"))
            if implicit or any(SH + k in t for k in ("targetNode", "targetClass", "targetSubjectsOf", "targetObjectsOf", "target")):
                out.append((s, implicit))
        return out

    def path(self, node):
        """Path tuple of a SHACL path."""
        if node[0] == "iri":
            return ("link", node[1])
        for name, kind in (("inversePath", "inv"), ("zeroOrMorePath", "star"), ("oneOrMorePath", "plus"), ("zeroOrOnePath", "opt")):
            if inner := self.one(node, name):
                return (kind, self.path(inner))
        if alt := self.one(node, "alternativePath"):
            return reduce(lambda a, b: ("alt", a, b), [self.path(x) for x in self.items(alt)])
        return reduce(lambda a, b: ("seq", a, b), [self.path(x) for x in self.items(node)])

    def check_recursion(self):
        """Raise if a shape refers to itself."""
        edges = {}
        for s, po in self.po.items():
            for name in ("node", "property", "not", "qualifiedValueShape"):
                edges.setdefault(s, []).extend(po.get(SH + name, []))
            for name in ("and", "or", "xone"):
                for lst in po.get(SH + name, []):
                    edges.setdefault(s, []).extend(self.items(lst))
        done, active = set(), set()

        def visit(s):
            if s in active:
                raise ValueError(f"recursive shape {s[1]}")
            if s in done:
                return
            active.add(s)
            for t in edges.get(s, ()):
                visit(t)
            active.discard(s)
            done.add(s)

        for s in list(edges):
            visit(s)


class Validator:
    """Validates one source against shapes."""

    def __init__(self, source, shapes, prefixes=None):
        shapes.check_recursion()
        self.source, self.shapes, self.spark, self.prefixes = source, shapes, source.spark, prefixes or {}
        self.compiler = Compiler(source)

    # plans over the source; focus and value are the variables f and v
    def decoded(self, plan, names):
        ids = [v for v in names if plan.vars.get(v) == ID]
        return P.decode(plan, ids, self.source.terms) if ids else plan

    def instances(self, cls):
        """Instances (f) of a class or its subclasses."""
        path = ("seq", ("link", TYPE), ("star", ("link", RDFS + "subClassOf")))
        try:
            plan = self.compiler.path(("var", "f"), path, cls, None)
        except ValueError:
            plan = self.source.star(("var", "f"), [(("iri", TYPE), cls)])
        direct = self.source.star(("var", "f"), [(("iri", TYPE), cls)])
        both = P.union([plan, direct])
        return Plan(both.df.distinct(), both.vars, both.must)

    def targets(self, shape, implicit):
        s, parts = self.shapes, []
        for t in s.get(shape, SH + "targetNode"):
            v = Val.const(t)
            parts.append(Plan(self.spark.range(1).select(*[c.alias(n) for c, n in zip(v.cols, columns("f", v.rep))]), {"f": v.rep}, frozenset({"f"})))
        for c in s.get(shape, SH + "targetClass") + ([shape] if implicit else []):
            parts.append(self.instances(c))
        for p in s.get(shape, SH + "targetSubjectsOf"):
            parts.append(self.source.star(("var", "f"), [(p, ("var", "x"))]).only(["f"]))
        for p in s.get(shape, SH + "targetObjectsOf"):
            parts.append(self.source.star(("var", "x"), [(p, ("var", "f"))]).only(["f"]))
        for t in s.get(shape, SH + "target"):
            if q := s.one(t, "select"):
                parts.append(self.select(q[1], t, {"this": "f"}))
        out = P.union([p.only(["f"]) for p in parts])
        return Plan(out.df.distinct(), out.vars, frozenset({"f"}))

    def select(self, text, node, rename=None):
        prefixes = dict(self.prefixes)
        for p in self.shapes.get(node, SH + "prefixes"):
            for d in self.shapes.get(p, SH + "declare"):
                prefixes[self.shapes.one(d, "prefix")[1]] = self.shapes.one(d, "namespace")[1]
        plan = self.compiler.select(parse_query(text.replace("$this", "?this").replace("$PATH", "?PATH"), prefixes))
        for a, b in (rename or {}).items():
            if a in plan.vars:
                plan = plan.with_vals({b: plan.val(a)}, {b} if a in plan.must else ()).only([b if v == a else v for v in plan.vars])
        return plan

    def values(self, focus, path):
        """(f, v) of a path from the focus nodes, distinct."""
        pairs = self.compiler.pairs(path, None)
        pairs = pairs.with_vals({"f": pairs.val("__s"), "v": pairs.val("__o")}, {"f", "v"}).only(["f", "v"])
        if path[0] == "link" or path[0] == "inv" and path[1][0] == "link":  # a scan, quick to count: all that follows is by focus node
            pairs = Plan(spread(pairs.df, pairs.df.count(), *columns("f", pairs.vars["f"])), pairs.vars, pairs.must)
        out = P.join(focus, pairs)
        return Plan(out.df.distinct(), out.vars, frozenset({"f", "v"}))

    # constraints: each gives the violating (f, v) or (f)
    def violations(self, shape, focus):
        """List of (component, plan with f and perhaps v, node for message and severity, path text) of a shape on focus nodes."""
        s, out = self.shapes, []
        if s.one(shape, "deactivated", (0, ""))[1] == "true":
            return out
        path_node = s.one(shape, "path")
        if path_node:
            at = s.path(path_node)
            vals = self.values(focus, at)
        else:
            at, vals = None, focus.with_vals({"v": focus.val("f")}, {"f", "v"})
        add = lambda component, plan: out.append((component, plan, shape, path_text(at)))
        num = lambda t: int(t[1])
        if path_node:
            limits = [(name, bad(num(t))) for name, bad in (("minCount", lambda k: lambda n: n < k), ("maxCount", lambda k: lambda n: n > k)) for t in s.get(shape, SH + name) if name == "maxCount" or num(t) > 0]
            counts = self.counts(focus, vals) if limits else None
            if len(limits) > 1:  # counted once for all of them
                counts = Plan(materialise(counts.df, "counts"), counts.vars, counts.must)
            for name, bad in limits:
                add(name, counts.filter(bad(counts.val("n").col)).only(["f"]))
            if s.one(shape, "uniqueLang", (0, ""))[1] == "true":
                d = self.decoded(vals, ["v"])
                lang = d.val("v").lang()
                d = d.filter(lang != "").with_vals({"lang": Val.string(F.lower(lang))})
                keys = [c for v in ("f", "lang") for c in columns(v, d.vars[v])]
                again = d.df.groupBy(*keys).count().where("count > 1")
                add("uniqueLang", Plan(again, {"f": d.vars["f"], "lang": d.vars["lang"]}, frozenset({"f"})).only(["f"]))
        tests = []
        for t in s.get(shape, SH + "datatype"):
            tests.append(("datatype", lambda v, t=t: self.datatype_ok(v, t[1])))
        for t in s.get(shape, SH + "nodeKind"):
            tests.append(("nodeKind", lambda v, t=t: v.kind().isin(*KINDS[t[1]])))
        for name, op in (("minInclusive", ">="), ("minExclusive", ">"), ("maxInclusive", "<="), ("maxExclusive", "<")):
            for t in s.get(shape, SH + name):
                tests.append((name, lambda v, t=t, op=op: less(v, Val.const(t), op)))
        for t in s.get(shape, SH + "minLength"):
            tests.append(("minLength", lambda v, t=t: (v.kind() != BNODE) & (F.length(v.lex()) >= num(t))))
        for t in s.get(shape, SH + "maxLength"):
            tests.append(("maxLength", lambda v, t=t: (v.kind() != BNODE) & (F.length(v.lex()) <= num(t))))
        for t in s.get(shape, SH + "pattern"):
            flags = s.one(shape, "flags", (0, ""))[1]
            tests.append(("pattern", lambda v, t=t, flags=flags: (v.kind() != BNODE) & v.lex().rlike((f"(?{flags})" if flags else "") + t[1])))
        for t in s.get(shape, SH + "languageIn"):
            langs = [x[1].lower() for x in s.items(t)]
            tests.append(("languageIn", lambda v, langs=langs: reduce(lambda a, b: a | b, [(v.lang() == x) | v.lang().startswith(x + "-") for x in langs], F.lit(False))))
        for t in s.get(shape, SH + "in"):
            items = s.items(t)
            tests.append(("in", lambda v, items=items: reduce(lambda a, b: a | b, [self.is_same(v, x) for x in items], F.lit(False))))
        if tests:
            d = self.decoded(vals, ["v"])
            for component, ok in tests:
                add(component, d.filter(~F.coalesce(ok(d.val("v")), F.lit(False))))
        for t in s.get(shape, SH + "hasValue"):
            hit = vals.filter(self.compiler.is_term(vals.val("v"), t)).only(["f"])
            add("hasValue", P.semi(focus, hit, anti=True))
        for t in s.get(shape, SH + "class"):
            inst = self.instances(t)
            inst = inst.with_vals({"v": inst.val("f")}, {"v"}).only(["v"])
            add("class", P.semi(vals, inst, anti=True))
        for name in ("equals", "disjoint"):
            for t in s.get(shape, SH + name):
                other = self.values(focus, ("link", t[1]))
                if name == "disjoint":
                    add(name, P.semi(vals, other))
                else:
                    add(name, P.union([P.semi(vals, other, anti=True), P.semi(other, vals, anti=True)]))
        for name, op in (("lessThan", "<"), ("lessThanOrEquals", "<=")):
            for t in s.get(shape, SH + name):
                other = self.values(focus, ("link", t[1]))
                other = other.with_vals({"w": other.val("v")}, {"w"}).only(["f", "w"])
                d = self.decoded(P.join(vals, other), ["v", "w"])
                add(name, d.filter(~F.coalesce(less(d.val("v"), d.val("w"), op), F.lit(False))).only(["f", "v"]))
        self.logical(shape, vals, add)
        for t in s.get(shape, SH + "qualifiedValueShape"):
            good = self.conforming(t, vals)
            if s.one(shape, "qualifiedValueShapesDisjoint", (0, ""))[1] == "true":
                for sibling in self.siblings(shape, t):
                    good = P.semi(good, self.as_values(self.conforming_nodes(sibling, self.as_focus(good))), anti=True)
            for n in s.get(shape, SH + "qualifiedMinCount"):
                add("qualifiedMinCount", self.by_count(focus, good, lambda c, n=n: c < num(n)))
            for n in s.get(shape, SH + "qualifiedMaxCount"):
                add("qualifiedMaxCount", self.by_count(focus, good, lambda c, n=n: c > num(n)))
        if s.one(shape, "closed", (0, ""))[1] == "true":
            allowed = [s.one(p, "path") for p in s.get(shape, SH + "property")] + [x for lst in s.get(shape, SH + "ignoredProperties") for x in s.items(lst)]
            t = self.source.star(("var", "f"), [(("var", "p"), ("var", "v"))])
            for a in allowed:
                if a and a[0] == "iri":
                    t = t.filter(~self.compiler.is_term(t.val("p"), a))
            add("closed", P.semi(t, focus).only(["f", "v"]))
        for p in s.get(shape, SH + "property"):
            inner = self.as_focus(vals) if path_node else focus
            out.extend(self.violations(p, inner))
        for c in s.get(shape, SH + "sparql"):
            out.extend(self.sparql(shape, c, focus, at))
        return out

    def sparql(self, shape, node, focus, at):
        s = self.shapes
        if s.one(node, "deactivated", (0, ""))[1] == "true":
            return []
        if q := s.one(node, "select"):
            text = q[1].replace("$PATH", f"<{at[1]}>") if at and at[0] == "link" else q[1]
            found = self.select(text, node, {"this": "f", "value": "v"})
            return [("sparql", P.semi(found.only([x for x in ("f", "v") if x in found.vars]), focus), node, path_text(at))]
        q = s.one(node, "ask")[1]
        body = q[q.index("{") :]
        good = self.select("SELECT DISTINCT ?this WHERE " + body, node, {"this": "f"})
        return [("sparql", P.semi(focus, good, anti=True), node, path_text(at))]

    def logical(self, shape, vals, add):
        s = self.shapes
        for t in s.get(shape, SH + "node"):
            add("node", P.semi(vals, self.conforming(t, vals), anti=True))
        for t in s.get(shape, SH + "not"):
            add("not", P.semi(vals, self.conforming(t, vals)))
        for lst in s.get(shape, SH + "and"):
            bad = [P.semi(vals, self.conforming(t, vals), anti=True) for t in s.items(lst)]
            add("and", self.distinct(P.union(bad)))
        for lst in s.get(shape, SH + "or"):
            left = vals
            for t in s.items(lst):
                left = P.semi(left, self.conforming(t, vals), anti=True)
            add("or", left)
        for lst in s.get(shape, SH + "xone"):
            every = P.union([self.conforming(t, vals) for t in s.items(lst)])
            keys = [c for v in ("f", "v") for c in columns(v, every.vars[v])]
            once = Plan(every.df.groupBy(*keys).count().where("count = 1").select(*keys), every.vars, frozenset({"f", "v"}))
            add("xone", P.semi(vals, once, anti=True))

    def distinct(self, plan):
        return Plan(plan.df.distinct(), plan.vars, plan.must)

    def as_focus(self, vals):
        """The distinct values as focus nodes."""
        return self.distinct(vals.with_vals({"f": vals.val("v")}, {"f"}).only(["f"]))

    @staticmethod
    def as_values(nodes):
        return nodes.with_vals({"v": nodes.val("f")}, {"v"}).only(["v"])

    def conforming_nodes(self, shape, focus):
        """Focus nodes without a violation of the shape."""
        out = focus
        for _, plan, _, _ in self.violations(shape, focus):
            out = P.semi(out, self.distinct(plan.only(["f"])), anti=True)
        return out

    def conforming(self, shape, vals):
        """The (f, v) whose value conforms to the shape."""
        return P.semi(vals, self.as_values(self.conforming_nodes(shape, self.as_focus(vals))))

    def siblings(self, shape, own):
        s = self.shapes
        parents = [p for p, po in s.po.items() if shape in po.get(SH + "property", [])]
        return [q for p in parents for prop in s.get(p, SH + "property") for q in s.get(prop, SH + "qualifiedValueShape") if q != own]

    def by_count(self, focus, vals, bad):
        """Focus nodes whose number of distinct values is bad."""
        counts = self.counts(focus, vals)
        return counts.filter(bad(counts.val("n").col)).only(["f"])

    def counts(self, focus, vals):
        """The number (n) of distinct values of each focus node (f)."""
        keys = columns("f", vals.vars["f"])
        n = vals.df.groupBy(*keys).agg(F.count(F.lit(1)).alias("q0_n"))
        rep = Val.integer(F.lit(1)).rep
        both = P.join(focus, Plan(n, {"f": vals.vars["f"], "n": rep}, frozenset({"f", "n"})), "left")
        return both.with_vals({"n": Val(rep, F.coalesce(both.val("n").col, F.lit(0)))}, {"n"})

    @staticmethod
    def datatype_ok(v, dt):
        right = (v.kind() == LIT) & (v.dt() == dt)
        return right & cast(dt, Val.string(v.lex())).bound() if dt in CASTS and dt != STRING and v.rep == ANY else right

    @staticmethod
    def is_same(v, t):
        c = Val.const(t)
        return equal(v, c) if v.rep != ANY else v.term() == c.term()

    def report(self):
        """DataFrame of all violations."""
        s, parts = self.shapes, []
        for shape, implicit in s.roots():
            focus = self.targets(shape, implicit)
            for component, plan, node, path in self.violations(shape, focus):
                plan = self.decoded(plan, ["f", "v"])
                value = plan.val("v").lex() if "v" in plan.vars else F.lit(None).cast("string")
                severity = (s.one(node, "severity") or ("iri", SH + "Violation"))[1].removeprefix(SH)
                message = s.one(node, "message") or s.one(shape, "message")
                parts.append(plan.df.select(plan.val("f").lex().alias("focus"), F.lit(path).alias("path"), value.alias("value"), F.lit(component).alias("component"), F.lit(node[1]).alias("shape"), F.lit(severity).alias("severity"), F.lit(message[1] if message else f"{component} is violated").alias("message")))
        if not parts:
            return self.spark.createDataFrame([], ", ".join(f"{c} string" for c in REPORT))
        return reduce(lambda a, b: a.unionByName(b), parts).distinct()


def path_text(p):
    if p is None:
        return None
    if p[0] == "link":
        return p[1]
    inner = [path_text(x) for x in p[1:] if isinstance(x, tuple)]
    return {"inv": "^{}", "star": "{}*", "plus": "{}+", "opt": "{}?"}[p[0]].format(inner[0]) if p[0] in ("inv", "star", "plus", "opt") else {"seq": "/", "alt": "|"}[p[0]].join(inner)


def validate(source, shapes, prefixes=None):
    """Report of a source against a shapes text or Shapes."""
    return Validator(source, Shapes.from_text(shapes) if isinstance(shapes, str) else shapes, prefixes).report()


def report_lines(report):
    """The report as Turtle lines."""
    q = lambda c: F.to_json(F.array(c))
    text = lambda c: F.substring(q(F.col(c)), F.lit(2), F.length(q(F.col(c))) - 2)
    parts = [F.lit(f"[] a <{SH}ValidationResult>"), F.concat(F.lit(f" ; <{SH}focusNode> "), text("focus")), F.concat(F.lit(f" ; <{SH}sourceConstraintComponent> "), text("component")), F.concat(F.lit(f" ; <{SH}resultSeverity> "), text("severity")), F.concat(F.lit(f" ; <{SH}resultMessage> "), text("message"))]
    parts += [F.when(F.col(c).isNotNull(), F.concat(F.lit(f" ; <{SH}{n}> "), text(c))).otherwise("") for c, n in (("path", "resultPath"), ("value", "value"))]
    return report.select(F.concat(*parts, F.lit(" .")).alias("value"))


__all__ = ["Shapes", "Validator", "report_lines", "validate"]
