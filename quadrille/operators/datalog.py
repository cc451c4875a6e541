"""Stratified Datalog over a quad table: parser, stratification, semi-naive fixpoint, incremental maintenance.

Rules of one shape (equal but for constants) are one plan: their constants form a small table that joins the patterns, so
thousands of rules of an ontology are a handful of joins a round.
"""

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import functions as F

from ..functions.names import OWL, RDF, RDFS, TYPE, XSD
from ..functions.terms import ID, Val, term_id
from ..plans import plan as P
from ..plans.plan import Plan, columns
from ..plans.store import discard, materialise, spread
from ..sources.quads import QuadSource, clustered
from ..sources.rdf import DEFAULT
from ..sparql.compile import Compiler, variables
from ..sparql.parser import Parser, SyntaxFault

TOP = ("iri", DEFAULT)


@dataclass(frozen=True)
class Rule:
    """head is an atom (s, p, o, g) or None for a contradiction; body holds ("pos", atom), ("not", atom), ("neq", a, b), ("filter", e)."""

    head: tuple | None
    body: tuple

    def positive(self):
        return [x[1] for x in self.body if x[0] == "pos"]


class RuleParser(Parser):
    """Rules such as  ex:p[?s, ?o] :- [?s, ex:q, ?x], NOT ex:T[?x], ?x != ?o, FILTER(?x > 3) ."""

    def __init__(self, text):
        super().__init__(text, {"rdf": RDF, "rdfs": RDFS, "owl": OWL, "xsd": XSD})

    def rules(self):
        out = []
        while self.peek()[0] != "end":
            kind, text = self.peek()
            if (kind, text) == ("lang", "@prefix") or self.is_word("PREFIX"):
                self.next()
                name = self.next()[1]
                self.prefixes[name[:-1]] = self.iri()
                self.take_op(".")
                continue
            head = None
            if (kind, text) == ("word", "false"):
                self.next()
            else:
                head = self.atom()
            body = []
            if self.peek()[1].startswith(":") and self.peek(1)[1] == "-":
                self.next()
                self.next()
                body.append(self.element())
                while self.take_op(","):
                    body.append(self.element())
            self.take_op(".")
            out.append(Rule(head, tuple(body)))
        for r in out:
            check_safe(r)
        return list(dict.fromkeys(out))

    def element(self):
        if self.take_word("NOT"):
            return ("not", self.atom())
        if self.take_word("FILTER"):
            self.need_op("(")
            e = self.expression()
            self.need_op(")")
            return ("filter", _freeze(e))
        if self.peek()[0] == "var" and self.peek(1) == ("op", "!="):
            a = self.term([])
            self.next()
            return ("neq", a, self.term([]))
        return ("pos", self.atom())

    def part(self):
        if self.peek() == ("word", "a"):
            self.next()
            return ("iri", TYPE)
        return self.term([])

    def atom(self):
        if self.take_op("["):
            s = self.part()
            self.need_op(",")
            p = self.part()
            self.need_op(",")
            o = self.part()
            self.need_op("]")
        else:
            p = self.part()
            self.need_op("[")
            s, o = self.part(), None
            if self.take_op(","):
                o = self.part()
            self.need_op("]")
            if o is None:
                p, o = ("iri", TYPE), p
        g = self.part() if self.peek()[0] in ("var", "iri") or self.peek()[0] == "pname" and not self.peek()[1].startswith(":") else TOP
        return (s, p, o, g)


def _freeze(e):
    return tuple(_freeze(x) for x in e) if isinstance(e, (tuple, list)) else e


def _thaw(e):
    """Function arguments as lists again."""
    if isinstance(e, tuple) and e and e[0] == "call":
        return ("call", e[1], [_thaw(x) for x in e[2]])
    return e


def parse_rules(text):
    return RuleParser(text).rules()


def check_safe(rule):
    """Head variables and variables of negated atoms' comparisons must occur in a positive atom."""
    bound = {t[1] for a in rule.positive() for t in a if t[0] == "var"}
    need = {t[1] for t in rule.head or () if t[0] == "var"}
    if need - bound:
        raise SyntaxFault(f"unsafe rule: ?{sorted(need - bound)[0]} isn't bound by a positive atom")


def unifiable(a, b):
    return all(x == y or x[0] == "var" or y[0] == "var" for x, y in zip(a, b))


def stratify(rules):
    """Rules in evaluation order, a list of lists; raises if negation occurs in a cycle."""
    rules = list(rules)
    n = len(rules)
    by_key = {}
    for i, r in enumerate(rules):
        if r.head:
            p, o = r.head[1], r.head[2]
            by_key.setdefault((p if p[0] != "var" else None, o if p == ("iri", TYPE) and o[0] != "var" else None), []).append(i)
    keys = list(by_key)

    def feeders(atom):
        p, o = atom[1], atom[2]
        for k in keys:
            if (k[0] is None or p[0] == "var" or k[0] == p) and (k[1] is None or p[0] == "var" or o[0] == "var" or k[1] == o):
                yield from (i for i in by_key[k] if unifiable(rules[i].head, atom))

    deps = [([j for x in r.body if x[0] == "pos" for j in feeders(x[1])], [j for x in r.body if x[0] == "not" for j in feeders(x[1])]) for r in rules]
    # Tarjan's components, iteratively
    index, low, on, stack, order, comp = [-1] * n, [0] * n, [False] * n, [], [], [-1] * n
    count = 0
    for root in range(n):
        if index[root] >= 0:
            continue
        work = [(root, iter(set(deps[root][0] + deps[root][1])))]
        index[root] = low[root] = count
        count += 1
        stack.append(root)
        on[root] = True
        while work:
            v, it = work[-1]
            for w in it:
                if index[w] < 0:
                    index[w] = low[w] = count
                    count += 1
                    stack.append(w)
                    on[w] = True
                    work.append((w, iter(set(deps[w][0] + deps[w][1]))))
                    break
                if on[w]:
                    low[v] = min(low[v], index[w])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[v])
                if low[v] == index[v]:
                    members = []
                    while True:
                        w = stack.pop()
                        on[w] = False
                        comp[w] = len(order)
                        members.append(w)
                        if w == v:
                            break
                    order.append(members)
    for i in range(n):
        if any(comp[j] == comp[i] for j in deps[i][1]):
            raise ValueError("rules aren't stratifiable: a negation depends on itself")
    # merge components into strata: as low as dependencies and negations allow
    level = [0] * len(order)
    for c, members in enumerate(order):
        for i in members:
            for j in deps[i][0]:
                if comp[j] != c:
                    level[c] = max(level[c], level[comp[j]])
            for j in deps[i][1]:
                level[c] = max(level[c], level[comp[j]] + 1)
    out = [[] for _ in range(max(level, default=-1) + 1)]
    for i in range(n):
        out[level[comp[i]]].append(rules[i])
    return out


def shape(rule):
    """(rule with constants of its atoms replaced by placeholder variables, the constants)."""
    consts, seen = [], {}

    def swap(t):
        if t[0] == "var" or t == TOP:
            return t
        if t not in seen:
            seen[t] = ("var", f"__k{len(consts)}")
            consts.append(t)
        return seen[t]

    move = lambda a: tuple(swap(t) for t in a)
    body = tuple((x[0], move(x[1])) if x[0] in ("pos", "not") else x for x in rule.body)
    return Rule(move(rule.head) if rule.head else None, body), tuple(consts)


class Program:
    """Rules grouped for evaluation over a quad source."""

    def __init__(self, source, rules, min_group=3):
        self.spark, self.source, self.rules = source.spark, source, list(rules)
        self.groups = []
        shapes = {}
        for r in self.rules:
            s, consts = shape(r)
            shapes.setdefault(s, []).append((r, consts))
        for s, members in shapes.items():
            if len(members) >= min_group and any(x[0] == "pos" for x in s.body) and members[0][1]:
                self.groups.append((s, [c for _, c in members]))
            else:
                self.groups.extend((r, None) for r, _ in members)

    def constants(self, consts):
        """Plan of the constants of a group: one row a rule."""
        width = len(consts[0])
        kind = "struct<kind:int,lex:string,dt:string,lang:string>"
        from ..sources.rdf import tuple_struct

        df = self.spark.createDataFrame([tuple(tuple_struct(t) for t in row) for row in consts], ", ".join(f"c{i} {kind}" for i in range(width)))
        df = df.select(*[term_id(F.col(f"c{i}")).alias(columns(f"__k{i}", ID)[0]) for i in range(width)])
        return Plan(df, {f"__k{i}": ID for i in range(width)}, frozenset(f"__k{i}" for i in range(width)))

    def atom(self, atom, quads):
        s, p, o, g = atom
        graph = None if g == TOP else g
        return QuadSource(self.spark, quads, self.source.terms).pattern(s, p, o, graph)

    def heads(self, rule, consts, full, delta=None, at=None, body=False, old=None):
        """Ids (g, s, p, o) that a rule derives, with atom number `at` read from delta and those before it from old; with body also the quads it used.

        Atoms of known predicates on one subject are joined first, so that a join on a value which many subjects share meets
        only subjects that pass the rest; the ids of such a join may repeat.
        """
        out = self.constants(consts) if consts else P.unit(self.spark)
        positive = rule.positive()
        read = lambda i: self.atom(positive[i], delta if i == at else old if old is not None and at is not None and i < at else full)
        stars = {}
        for i, (s, p, _, g) in enumerate(positive):
            stars.setdefault((s, g) if s[0] == "var" and p[0] != "var" else i, []).append(i)
        order = sorted(stars.values(), key=lambda x: x[0])
        seen = set(out.vars)
        while order:
            names = lambda x: {t[1] for i in x for t in positive[i] if t[0] == "var"}
            pick = next((x for x in order if at in x), None) or next((x for x in order if seen & names(x)), order[0])
            order.remove(pick)
            out = P.join(out, reduce(P.join, [read(i) for i in sorted(pick, key=lambda i: i != at)]))
            seen |= names(pick)
        compiler = Compiler(QuadSource(self.spark, full, self.source.terms))
        ident = lambda t: out.val(t[1]).id() if t[0] == "var" and out.vars[t[1]] == ID else Val.const(t).id()
        for x in rule.body:
            if x[0] == "neq":
                out = out.filter(ident(x[1]) != ident(x[2]))
        ids = out
        for x in rule.body:
            if x[0] == "filter":
                names = [v for v in variables(x[1]) if v in out.vars]
                keep = {v: f"__id_{v}" for v in names}
                out = out.with_vals({k: out.val(v) for v, k in keep.items()}, set(keep.values()))
                out = compiler.filter(out, _thaw(x[1]))
                out = out.with_vals({v: out.val(k) for v, k in keep.items()}, set(keep)).only(list(ids.vars))
        for x in rule.body:
            if x[0] == "not":
                out = P.semi(out, self.atom(x[1], full), anti=True)
        if rule.head is None:
            return out.df
        quad = lambda s, p, o, g: [ident(t).alias(c) for t, c in ((("iri", DEFAULT) if g == TOP else g, "g"), (s, "s"), (p, "p"), (o, "o"))]
        s, p, o, g = rule.head
        used = [F.array(*[F.struct(*quad(*a)) for a in positive]).alias("body")] if body else []
        out = out.df.select(*[ident(t).alias(c) for t, c in ((g, "g"), (s, "s"), (p, "p"), (o, "o"))], *used)
        return out.distinct() if body else out

    def step(self, rules, full, delta=None, old=None):
        """Everything the groups of these rules derive, distinct; with delta, using it in one atom at least.

        old is full without delta: the first atom that reads delta has those before it read old, so that no binding is found twice.
        What many rows derive is stored as found, and then made distinct in partitions that fit its number.
        """
        wanted, parts = set(rules), []
        for rule, consts in self.groups:
            if rule.head is None:
                continue
            own = [r for r in self.rules if r in wanted and (r == rule if consts is None else shape(r)[0] == rule)]
            if not own:
                continue
            use = consts and [shape(r)[1] for r in own]
            if not rule.positive():
                if delta is None:
                    parts.append(self.heads(rule, use, full))
            elif delta is None:
                parts.append(self.heads(rule, use, full))
            else:
                parts.extend(self.heads(rule, use, full, delta, i, old=old) for i in range(len(rule.positive())))
        if not parts:
            return None
        found = materialise(reduce(lambda a, b: a.unionByName(b), parts), "found")
        return spread(found, found.count(), *KEY).distinct()


KEY = ["g", "s", "p", "o"]


def with_head_terms(source, rules):
    """The source with the rules' constants in its dictionary."""
    from ..sources.rdf import tuple_struct

    terms = list(dict.fromkeys(t for r in rules if r.head for t in r.head if t[0] != "var"))
    if not terms:
        return source
    df = source.spark.createDataFrame([(tuple_struct(t),) for t in terms], "term struct<kind:int,lex:string,dt:string,lang:string>")
    return source.with_quads(source.quads, df.select(term_id(F.col("term")).alias("id"), "term"))


def reachable(full, rules):
    """The quads that a head of these rules can equal: those with one of its predicates, where all are constants."""
    names = {r.head[1] for r in rules if r.head}
    if any(n[0] == "var" for n in names):
        return full
    kinds = {r.head[2] for r in rules if r.head and r.head[1] == ("iri", TYPE)}
    ids = lambda terms: [Val.const(t).id() for t in sorted(terms, key=str)]
    known = F.col("p").isin(*ids(names - {("iri", TYPE)})) if names - {("iri", TYPE)} else F.lit(False)
    if ("iri", TYPE) in names:
        typed = F.col("p") == Val.const(("iri", TYPE)).id()
        known = known | (typed & F.col("o").isin(*ids(kinds)) if all(k[0] != "var" for k in kinds) and len(kinds) <= 1000 else typed)
    return full.where(known)


def _loop(program, rules, full, delta, max_rounds, old=None):
    """Semi-naive rounds from a first delta; full already holds it, old is full without it."""
    parts = []
    for _ in range(max_rounds):
        found = program.step(rules, full, delta, old)
        if found is None:
            return full
        new = materialise(found.join(reachable(full, rules).select(*KEY), KEY, "left_anti").withColumn("derived", F.lit(True)), "delta")
        discard(found)
        if new.isEmpty():
            return full
        parts.append(new)
        old, full, delta = full, full.unionByName(new), new
        if len(parts) >= 8:  # fold the rounds, so that a round doesn't read ever more small tables
            full = materialise(clustered(full), "facts")
            discard(*parts[:-1])
            parts, old = [], None  # old read the removed files
    raise RuntimeError("rules didn't settle")


def materialise_rules(source, rules, max_rounds=10_000, check=True):
    """A source with everything the rules derive; derived quads are marked."""
    source = with_head_terms(source, rules)
    full, made = source.quads, 0
    for stratum in stratify([r for r in rules if r.head]):
        program = Program(source, stratum)
        found = program.step(stratum, full)
        if found is None:
            continue
        new = materialise(found.join(reachable(full, stratum).select(*KEY), KEY, "left_anti").withColumn("derived", F.lit(True)), "delta")
        discard(found)
        if not new.isEmpty():
            full = _loop(program, stratum, full.unionByName(new), new, max_rounds, full)
            made += 1
    if made:
        full = materialise(clustered(full), "facts")
    out = QuadSource(source.spark, full, source.terms)
    if check:
        check_contradictions(out, rules)
    return out


class Contradiction(ValueError):
    """The data satisfies the body of a rule that concludes false."""


def check_contradictions(source, rules):
    for r in rules:
        if r.head is None and not Program(source, [r]).heads(r, None, source.quads).isEmpty():
            raise Contradiction(str(r.body))


def provenance(source, rules):
    """How each derived quad of a materialised source follows in one step: rows (g, s, p, o, rule, body).

    rule is the rule's place in the list and body the ids of the quads it used, one for each positive atom; a quad that
    several rules or bindings derive has a row for each.  Nothing is stored while rules run: the index is a query.
    """
    out = None
    for n, r in enumerate(rules):
        if r.head and r.positive():
            rows = Program(source, [r]).heads(r, None, source.quads, body=True).withColumn("rule", F.lit(n))
            out = rows if out is None else out.unionByName(rows)
    if out is None:
        return source.quads.limit(0).select(*KEY, F.lit(0).alias("rule"), F.array(F.struct(*KEY)).alias("body"))
    return out.join(source.quads.where("derived").select(*KEY), KEY, "left_semi").select(*KEY, "rule", "body")


def naive(source, rules, max_rounds=1000):
    """Plain iteration of all rules of a stratum; the test oracle for the semi-naive loop."""
    source = with_head_terms(source, rules)
    full = source.quads
    for stratum in stratify([r for r in rules if r.head]):
        program = Program(source, stratum, min_group=1 << 30)
        for _ in range(max_rounds):
            new = materialise(program.step(stratum, full).join(full, KEY, "left_anti").withColumn("derived", F.lit(True)), "naive")
            if new.isEmpty():
                break
            full = full.unionByName(new)
    return QuadSource(source.spark, full, source.terms)


def insert_quads(source, rules, ids, terms=None):
    """Incremental insertion of quads (g, s, p, o ids) into a materialised source."""
    source = with_head_terms(source.with_quads(source.quads, terms), rules)
    asserted = materialise(ids.select(*KEY).distinct().withColumn("derived", F.lit(False)), "asserted")
    fresh = materialise(asserted.join(source.quads, KEY, "left_anti"), "fresh")
    full = source.quads.join(asserted.select(*KEY), KEY, "left_anti").unionByName(asserted)
    if any(x[0] == "not" for r in rules for x in r.body):
        base = QuadSource(source.spark, full.where("not derived"), source.terms)
        return materialise_rules(base, rules)
    active = [r for r in rules if r.head]
    full = _loop(Program(source, active), active, materialise(full, "facts"), fresh, 10_000)
    return QuadSource(source.spark, materialise(full, "facts"), source.terms)


def delete_quads(source, rules, ids, fallback=0.25):
    """Incremental deletion: over-delete what may depend on the deleted quads, then re-derive what still holds.

    Above the given share of possibly deleted derived quads, or with negation, the closure is rebuilt from the base.
    """
    spark, full = source.spark, source.quads
    gone = materialise(ids.select(*KEY).distinct().join(full.where("not derived").select(*KEY), KEY, "left_semi"), "gone")
    base = full.where("not derived").join(gone, KEY, "left_anti")
    if any(x[0] == "not" for r in rules for x in r.body):
        return materialise_rules(QuadSource(spark, materialise(base, "base"), source.terms), rules)
    active = [r for r in rules if r.head]
    program = Program(source, active)
    derived = full.where("derived").select(*KEY)
    total = derived.count()
    over, delta = gone, gone.withColumn("derived", F.lit(False))
    while True:
        found = program.step(active, full, delta)
        if found is None:
            break
        new = materialise(found.join(derived, KEY, "left_semi").join(over, KEY, "left_anti"), "over")
        if new.isEmpty():
            break
        over, delta = over.unionByName(new), new.withColumn("derived", F.lit(True))
    if total and over.count() > fallback * total + gone.count():
        return materialise_rules(QuadSource(spark, materialise(base, "base"), source.terms), rules)
    left = materialise(full.join(over, KEY, "left_anti"), "left")
    again = program.step(active, left)
    back = materialise(again.join(over, KEY, "left_semi").join(left, KEY, "left_anti").withColumn("derived", F.lit(True)), "back") if again is not None else left.limit(0)
    if not back.isEmpty():
        left = _loop(program, active, left.unionByName(back), back, 10_000)
    return QuadSource(spark, materialise(left, "facts"), source.terms)


def insert_rules(source, rules, new):
    """Add rules to a materialised source; with negation, from the base quads, because what was derived may no longer hold."""
    every = [*rules, *new]
    if any(x[0] == "not" for r in every for x in r.body):
        source = QuadSource(source.spark, source.quads.where("not derived"), source.terms)
    return materialise_rules(source, every)


def delete_rules(source, rules, old):
    """Remove rules: the closure of what stays, from the base quads."""
    base = QuadSource(source.spark, source.quads.where("not derived"), source.terms)
    return materialise_rules(base, [r for r in rules if r not in set(old)])
