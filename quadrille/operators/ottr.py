"""OTTR templates: a template compiles once to flat triples with list expansions; instances are rows."""

from pyspark.sql import functions as F

from ..functions.names import RDF, XSD
from ..functions.terms import TERM, Val
from ..sources.rdf import DEFAULT, TERM4, parse_document
from ..sparql.parser import Parser, SyntaxFault

OTTR = "http://ns.ottr.xyz/0.4/"
NONE = ("none",)


class Document(Parser):
    """stOTTR text: templates {iri: (params, body)} and instances [(iri, args, expander)]."""

    def __init__(self, text):
        super().__init__(text, {"ottr": OTTR, "rdf": RDF, "xsd": XSD})
        self.templates, self.instances = {}, []

    def blank(self, label):
        return ("bnode", label)

    def parse(self):
        while self.peek()[0] != "end":
            if self.peek() == ("lang", "@prefix") or self.is_word("PREFIX"):
                self.next()
                name = self.next()[1]
                self.prefixes[name[:-1]] = self.iri()
                self.take_op(".")
                continue
            mark = self.at
            if not self.is_word("cross", "zipMin", "zipMax", "CROSS", "ZIPMIN", "ZIPMAX"):
                name = self.iri()
                if self.is_op("["):
                    self.templates[name] = self.template_rest()
                    self.take_op(".")
                    continue
            self.at = mark
            self.instances.append(self.instance())
            self.take_op(".")
        return self

    def template_rest(self):
        self.need_op("[")
        params = []
        while not self.take_op("]"):
            optional = False
            while self.is_op("?", "!"):
                optional = self.next()[1] == "?" or optional
            if self.peek()[0] in ("iri", "pname") or self.is_word("List", "NEList"):
                self.kind()
            name, default = self.next()[1][1:], None
            if self.take_op("="):
                default = self.argument()
            params.append((name, optional, default))
            self.take_op(",")
        while self.peek()[1].startswith(":"):
            self.next()
        body = []
        if self.take_op("{"):
            while not self.take_op("}"):
                body.append(self.instance())
                self.take_op(",")
        return params, body

    def kind(self):
        """A parameter type; not checked."""
        if self.is_word("List", "NEList"):
            self.next()
            self.take_op("<")
            self.kind()
            self.take_op(">")
        else:
            self.iri()

    def instance(self):
        expander = self.take_word("CROSS", "ZIPMIN", "ZIPMAX")
        if expander:
            self.need_op("|")
        name = self.iri()
        self.need_op("(")
        args = []
        while not self.take_op(")"):
            args.append(self.argument())
            self.take_op(",")
        return name, args, expander

    def argument(self):
        each = False
        while self.is_op("+"):
            self.next()
            each = True
        if self.take_word("none", "NONE"):
            a = NONE
        elif self.take_op("("):
            items = []
            while not self.take_op(")"):
                items.append(self.argument())
                self.take_op(",")
            a = ("list", tuple(items))
        elif self.take_op("["):
            self.need_op("]")
            a = ("fresh",)
        else:
            a = self.term([])
        return ("each", a) if each else a


def parse_stottr(text):
    return Document(text).parse()


class Encoded:
    """Templates and instances of an RDF document in the wOTTR vocabulary, as those of a stOTTR text."""

    MODES = {"cross": "CROSS", "zipMin": "ZIPMIN", "zipMax": "ZIPMAX"}

    def __init__(self, text, fmt="turtle"):
        self.po, self.templates, self.instances = {}, {}, []
        for s, p, o, _ in parse_document(text, fmt):
            self.po.setdefault(s, {}).setdefault(p[1], []).append(o)
        named = [s for s, po in self.po.items() if ("iri", OTTR + "Template") in po.get(RDF + "type", [])]
        params = {t: [self.parameter(x) for x in self.items(self.one(t, "parameters"))] for t in named}
        self.variables = {v: n for ps in params.values() for v, n, _, _ in ps}
        inner = set()
        for t in named:
            parts = self.po[t].get(OTTR + "pattern", [])
            inner.update(parts)
            self.templates[t[1]] = ([(n, optional, self.argument(default) if default else None) for _, n, optional, default in params[t]], [self.instance(x) for x in parts])
        self.instances = [self.instance(s) for s in self.po if OTTR + "of" in self.po[s] and s not in inner]

    def one(self, s, name):
        return next(iter(self.po.get(s, {}).get(OTTR + name, [])), None)

    def items(self, node):
        out = []
        while node in self.po and RDF + "first" in self.po[node]:
            out.append(self.po[node][RDF + "first"][0])
            node = self.po[node][RDF + "rest"][0]
        return out

    def parameter(self, node):
        """(variable node, name, optional, default) of a parameter."""
        v = self.one(node, "variable")
        modifiers = self.po.get(node, {}).get(OTTR + "modifier", [])
        return v, f"v_{v[0]}_{v[1]}", ("iri", OTTR + "optional") in modifiers, self.one(node, "default")

    def argument(self, t):
        if t == ("iri", OTTR + "none"):
            return NONE
        if t in self.variables:
            return ("var", self.variables[t])
        if t == ("iri", RDF + "nil") or RDF + "first" in self.po.get(t, {}):
            return ("list", tuple(self.argument(x) for x in self.items(t)))
        return t

    def instance(self, node):
        """(template, arguments, expander); arguments come as plain values or with modifiers."""
        args = [self.argument(x) for x in self.items(self.one(node, "values"))]
        for x in self.items(self.one(node, "arguments")):
            a = self.argument(self.one(x, "value"))
            args.append(("each", a) if self.one(x, "modifier") == ("iri", OTTR + "listExpand") else a)
        mode = self.one(node, "modifier")
        return self.one(node, "of")[1], args, self.MODES[mode[1].removeprefix(OTTR)] if mode else None


def parse_wottr(text, fmt="turtle"):
    return Encoded(text, fmt)


def flatten(templates, name, args, expander=None, active=()):
    """Triples of an instance: (s, p, o, steps), steps being list expansions (mode, [(new variable, list argument)])."""
    if name in active:
        raise ValueError(f"recursive template {name}")
    steps = []
    if expander:
        bound, plain = [], []
        for a in args:
            if a[0] == "each":
                v = ("var", f"__e{len(active)}_{len(bound)}_{abs(hash((name, a, active))) % 10**8}")
                bound.append((v[1], a[1]))
                plain.append(v)
            else:
                plain.append(a)
        args, steps = plain, [(expander, bound)]
    if name == OTTR + "Triple" or name == OTTR + "NullableTriple":
        return [(*args[:3], steps)]
    if name not in templates:
        raise SyntaxFault(f"unknown template {name}")
    params, body = templates[name]
    if len(args) > len(params):
        raise SyntaxFault(f"too many arguments for {name}")
    env = {}
    for i, (p, _, default) in enumerate(params):
        a = args[i] if i < len(args) else NONE
        env[p] = default if a == NONE and default is not None else a
    # a none for a parameter that isn't optional leaves out the whole instance
    if any(env[p] == NONE and not optional for p, optional, _ in params):
        return []

    def put(a):
        if a[0] == "var":
            return env.get(a[1], a)
        if a[0] == "each":
            return ("each", put(a[1]))
        if a[0] == "list":
            return ("list", tuple(put(x) for x in a[1]))
        return a

    out = []
    for n, inner, exp in body:
        for s, p, o, more in flatten(templates, n, [put(a) for a in inner], exp, (*active, name)):
            out.append((s, p, o, steps + more))
    return out


def instance_quads(df, triples, columns):
    """Quads of flat triples over rows; columns maps a variable to a term struct (or array of them) column."""
    out = None
    for s, p, o, steps in triples:
        part, env = df, dict(columns)

        def value(a, env=env):
            if a == NONE:
                return F.lit(None).cast(TERM)
            if a[0] == "var":
                return env.get(a[1], F.lit(None).cast(TERM))
            if a[0] == "list":
                return F.array(*[value(x) for x in a[1]]) if a[1] else F.array().cast(f"array<{TERM}>")
            if a[0] == "bnode":
                from ..functions.terms import BNODE, term

                return term(BNODE, F.lit(a[1]))
            return Val.const(a).term()

        for mode, bound in steps:
            if mode == "CROSS":
                for v, a in bound:
                    part = part.withColumn(v, F.explode(value(a)))
                    env[v] = F.col(v)
            else:
                lists = [value(a) for _, a in bound]
                for i, x in enumerate(lists):
                    part = part.withColumn(f"q_z{i}", x)
                zipped = F.arrays_zip(*[f"q_z{i}" for i in range(len(lists))])
                if mode == "ZIPMIN":
                    zipped = F.slice(zipped, F.lit(1), F.array_min(F.array(*[F.size(f"q_z{i}") for i in range(len(lists))])))
                name = f"q_zip{len(env)}"
                part = part.withColumn(name, F.explode(zipped))
                for i, (v, _) in enumerate(bound):
                    env[v] = F.col(name).getField(f"q_z{i}")
        rows = part.select(value(s).alias("s"), value(p).alias("p"), value(o).alias("o"), Val.const(("iri", DEFAULT)).term().alias("g"))
        rows = rows.where("s is not null and p is not null and o is not null")
        out = rows if out is None else out.unionByName(rows)
    return out.distinct() if out is not None else None


def expand_document(spark, *texts):
    """Quads of all instances in stOTTR texts (or parsed documents), with the templates of all of them."""
    docs = [parse_stottr(t) if isinstance(t, str) else t for t in texts]
    templates = {k: v for d in docs for k, v in d.templates.items()}
    out = None
    for name, args, expander in [i for d in docs for i in d.instances]:
        q = instance_quads(spark.range(1), flatten(templates, name, args, expander), {})
        if q is not None:
            out = q if out is None else out.unionByName(q)
    return out.distinct() if out is not None else spark.createDataFrame([], TERM4)


def expand_table(df, template_text, name, columns):
    """Quads of one template instance per row; columns are term struct columns in parameter order."""
    doc = parse_stottr(template_text)
    params = [p for p, _, _ in doc.templates[name][0]]
    triples = flatten(doc.templates, name, [("var", p) for p in params])
    return instance_quads(df, triples, dict(zip(params, columns)))


__all__ = ["expand_document", "expand_table", "flatten", "parse_stottr", "parse_wottr"]
