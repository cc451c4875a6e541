"""A quad table with a term dictionary.

quads(g, s, p, o, derived) holds 64-bit ids, terms(id, term) their terms.  An id is a hash of the term, so data loads in
parallel and computed terms get the id of equal stored ones without a lookup; loading fails if two terms share an id.
Patterns join on ids, and terms are decoded late, only for expressions, ordering and results.
"""

from pyspark.sql import functions as F

from ..functions.terms import ID, Val, term_id
from ..plans import plan as P
from ..plans.plan import Plan, columns
from ..plans.store import materialise, partitions, spread
from .rdf import DEFAULT, load, quads_from_text


def component_texts(column):
    """N-Triples texts of the three components of a triple term's text."""
    from .rdf import LITERAL, NODE

    return [F.regexp_extract(column, rf"^<<\(\s*({NODE})\s+(<[^<>]*>)\s+({NODE}|{LITERAL})\s*\)>>$", i) for i in (1, 2, 3)]


def with_components(every):
    """Distinct terms with the components of triple terms, nested ones too."""
    from .rdf import parse_term

    level = every.where("term.kind = 4")
    while level.limit(1).count():
        parts = level.select(F.explode(F.array(*component_texts("term.lex"))).alias("text")).distinct().select(parse_term(F.col("text")).alias("term"))
        level = materialise(parts.where("term is not null"), "components")
        every = every.unionByName(level).distinct()
        level = level.where("term.kind = 4")
    return every


MOST_LAYERS = 8


def clustered(ids, rows=None):
    """Quads in ranges of predicate and subject, sorted: a pattern's predicate prunes files and row groups by their statistics."""
    n = partitions(ids.count() if rows is None else rows)
    return (ids.repartitionByRange(n, "p", "s", "o") if n else ids.repartitionByRange("p", "s")).sortWithinPartitions("p", "s")


class QuadSource:
    """Patterns over a quad table; immutable, so an older source is a snapshot."""

    def __init__(self, spark, quads, terms):
        self.spark, self.quads, self.terms, self._stats, self.layers = spark, quads, terms, None, 0

    @staticmethod
    def from_quads(spark, quads, check=True, store=True):
        """Source of quads(s, p, o[, g]) of term structs."""
        if "g" not in quads.columns:
            quads = quads.withColumn("g", Val.const(("iri", DEFAULT)).term())
        if store:
            quads = materialise(quads.select("s", "p", "o", "g"), "quads")
        rows = quads.count() if store else 0
        if partitions(rows):  # subjects and objects may all differ, predicates and graphs are met again and again
            few = quads.select("p", "g").distinct().select(F.explode(F.array("p", "g")).alias("term"))
            every = spread(quads.select(F.explode(F.array("s", "o")).alias("term")).unionByName(few), 2 * rows, "term").distinct()
        else:
            every = quads.select(F.explode(F.array("s", "p", "o", "g")).alias("term")).distinct()
        if quads.where("s.kind = 4 or o.kind = 4").limit(1).count():
            every = with_components(every)
        terms = every.select(term_id(F.col("term")).alias("id"), "term")
        ids = spread(quads.select(*[term_id(F.col(c)).alias(c) for c in "gspo"]), rows, *"gspo").distinct().withColumn("derived", F.lit(False))
        if store:
            terms, ids = materialise(terms, "terms"), materialise(clustered(ids, rows), "ids")
        if check and spread(terms, 2 * rows, "id").groupBy("id").count().where("count > 1").limit(1).count():
            raise ValueError("two terms share an id")
        return QuadSource(spark, ids, terms)

    @staticmethod
    def from_text(spark, text, fmt="turtle", base=None):
        return QuadSource.from_quads(spark, quads_from_text(spark, text, fmt, base))

    @staticmethod
    def from_file(spark, path, fmt=None, base=None):
        return QuadSource.from_quads(spark, load(spark, path, fmt, base))

    def statistics(self):
        """Quads per predicate id, as a small dictionary for join ordering (at most 10,000 predicates)."""
        if self._stats is None:
            self._stats = {r.p: r["count"] for r in self.quads.groupBy("p").count().orderBy(F.desc("count")).limit(10_000).collect()}
        return self._stats

    def access(self, s, p, o):
        """(access path, most rows) of a triple pattern."""
        stats = self.statistics()
        if p[0] in ("iri", "link"):
            return "predicate range", stats.get(self.const_id(("iri", p[1])), 0)
        return ("full scan" if p[0] == "var" else "path closure"), sum(stats.values())

    def weight(self, pattern):
        s, p, o = pattern
        return (s[0] == "var") + (o[0] == "var") + 2 * (p[0] == "var")

    def graph_filter(self, graph):
        gid = lambda g: Val.const(("iri", g)).id()
        if graph is None:
            return F.col("g") == gid(DEFAULT)
        if graph[0] == "iri":
            return F.col("g") == gid(graph[1])
        if graph[0] == "set":
            return F.col("g").isin(*[gid(g) for g in graph[1]]) if graph[1] else F.lit(False)
        if graph[0] == "any":
            return F.lit(True)
        return F.col("g") != gid(DEFAULT)

    def pattern(self, s, p, o, graph=None):
        """Solutions of one quad pattern as ids."""
        df, names = self.quads.where(self.graph_filter(graph)), {}
        at = [(s, "s"), (p, "p"), (o, "o")] + ([(graph, "g")] if graph and graph[0] == "var" else [])
        for t, c in at:
            if t[0] == "var":
                if t[1] in names:
                    df = df.where(F.col(c) == F.col(names[t[1]]))
                else:
                    names[t[1]] = c
            elif t[0] != "triple" or not _open(t):
                df = df.where(F.col(c) == Val.const(t).id())
        out = df.select(*[F.col(c).alias(columns(v, ID)[0]) for v, c in names.items()], *[F.col(c).alias(f"q_t{c}") for t, c in at if t[0] == "triple" and _open(t)])
        if not (graph and graph[0] == "var") and graph and graph[0] in ("set", "any"):
            out = out.distinct()
        plan = Plan(out, dict.fromkeys(names, ID), frozenset(names))
        for t, c in at:
            if t[0] == "triple" and _open(t):
                plan = self.triple_term(plan, f"q_t{c}", t)
        if not plan.vars:
            plan = Plan(plan.df.select(F.lit(1).alias("q_one")))
        return plan

    def triple_term(self, plan, column, t, keep=False):
        """Join with the triple terms that fit a pattern with variables, triple terms inside it included."""
        from .rdf import parse_term

        known = self.terms.where("term.kind = 4").select(F.col("id").alias("q_id"), *[x.alias(f"q_x{i}") for i, x in enumerate(component_texts("term.lex"), 1)])
        at = column.replace("q_t", "q_n")  # own names, so that nested patterns don't clash
        known = known.withColumnsRenamed({"q_id": f"{at}_id", **{f"q_x{i}": f"{at}_x{i}" for i in (1, 2, 3)}})
        df = plan.df.join(known, F.col(column) == F.col(f"{at}_id"))
        out = Plan(df, plan.vars, plan.must)
        for i, x in enumerate(t[1:], 1):
            ident = term_id(parse_term(F.col(f"{at}_x{i}")))
            if x[0] == "triple" and _open(x):
                out = self.triple_term(Plan(out.df.withColumn(f"{column}_{i}", ident), out.vars, out.must), f"{column}_{i}", x, keep=True)
            elif x[0] == "var":
                if x[1] in out.vars:
                    out = out.filter(out.val(x[1]).col == ident)
                else:
                    out = Plan(out.df.withColumn(columns(x[1], ID)[0], ident), out.vars | {x[1]: ID}, out.must | {x[1]})
            else:
                out = out.filter(ident == Val.const(x).id())
        return out if keep else Plan(out.df.select(*[c for v, r in out.vars.items() for c in columns(v, r)], *[c for c in out.df.columns if c.startswith("q_t") and c != column]), out.vars, out.must)

    def star(self, subject, patterns, graph=None):
        """Solutions of patterns [(p, o)] on one subject: scans joined on the subject, rarest predicate first."""
        stats = self.statistics() if len(patterns) > 1 else {}
        size = (lambda po: stats.get(self.const_id(po[0]), 0) if po[0][0] == "iri" else 1 << 60) if stats else (lambda po: 0)
        out = None
        for p, o in sorted(patterns, key=lambda po: (o_var := po[1][0] == "var", size(po)) and (size(po) if o_var else -1)):
            plan = self.pattern(subject, p, o, graph)
            out = plan if out is None else P.join(out, plan)
        return out

    def const_id(self, t):
        """Id of a constant as a Python number; one tiny evaluation per constant, remembered."""
        cache = self.__dict__.setdefault("_ids", {})
        if t not in cache:
            cache[t] = self.spark.range(1).select(Val.const(t).id().alias("i")).first().i
        return cache[t]

    def as_terms(self, derived=None):
        """Quads (s, p, o, g) of term structs."""
        q = self.quads if derived is None else self.quads.where(F.col("derived") == derived)
        for c in "spog":
            q = q.join(self.terms.select(F.col("id").alias(c), F.col("term").alias(f"t_{c}")), c)
        return q.select(*[F.col(f"t_{c}").alias(c) for c in "spog"])

    def with_quads(self, ids, new_terms=None):
        """A new snapshot; its dictionary is this one's and the new terms, folded into one table every so often."""
        terms, layers = self.terms, self.layers
        if new_terms is not None:
            new = materialise(new_terms.select("id", "term").dropDuplicates(["id"]), "terms")
            terms, layers = terms.join(new.select("id"), "id", "left_anti").unionByName(new), layers + 1
            if layers >= MOST_LAYERS:
                terms, layers = materialise(terms, "terms"), 0
        out = QuadSource(self.spark, ids, terms)
        out.layers = layers
        return out


def _open(t):
    """Whether a triple term pattern holds a variable."""
    return t[0] == "var" or t[0] == "triple" and any(_open(x) for x in t[1:])


def quads_of(source, properties, classes=()):
    """Quads of term structs that a mapped source has for these properties and classes only."""
    from ..functions.names import TYPE

    out = None
    parts = [((("iri", p)), ("var", "o")) for p in properties] + [(("iri", TYPE), ("iri", c)) for c in classes]
    for p, o in parts:
        plan = source.star(("var", "s"), [(p, o)])
        obj = plan.val("o").term() if o[0] == "var" else Val.const(o).term()
        rows = plan.df.select(plan.val("s").term().alias("s"), Val.const(p).term().alias("p"), obj.alias("o"), Val.const(("iri", DEFAULT)).term().alias("g"))
        out = rows if out is None else out.unionByName(rows)
    return out
