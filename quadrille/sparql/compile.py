"""Queries to DataFrames: groups, paths, aggregation and solution modifiers over a triple source."""

from pyspark.sql import functions as F

from ..functions.names import XSD
from ..functions.scalar import arithmetic, call, dynamic_number
from ..functions.terms import ANY, BNODE, ID, IRI, LIT, TRIPLE, WHOLE, Rep, Val, common, convert, literal, term
from ..plans import plan as P
from ..plans.fixpoint import closure
from ..plans.plan import Plan, columns
from .parser import parse_query

FREE = {"BOUND"}


def variables(e):
    """Names of the variables in an expression or term, without those inside EXISTS."""
    if isinstance(e, tuple):
        if e[0] == "var":
            return {e[1]}
        if e[0] == "exists":
            return set()
        return set().union(*[variables(x) for x in e[1:]]) if len(e) > 1 else set()
    if isinstance(e, list):
        return set().union(*[variables(x) for x in e]) if e else set()
    return set()


def aggregates(e):
    if isinstance(e, tuple):
        return [e] if e[0] == "agg" else [a for x in e[1:] for a in aggregates(x)]
    return [a for x in e for a in aggregates(x)] if isinstance(e, list) else []


def find_exists(e):
    if isinstance(e, tuple):
        return [e] if e[0] == "exists" else [a for x in e[1:] for a in find_exists(x)]
    return [a for x in e for a in find_exists(x)] if isinstance(e, list) else []


def conjuncts(e):
    return [c for a in e[2] for c in conjuncts(a)] if e[0] == "call" and e[1] == "AND" else [e]


class Compiler:
    """Compiles one query over a source; graph is the active graph: None, ("iri", g), ("var", v) or ("set", [g])."""

    def __init__(self, source, base=None, reorder=True):
        self.source, self.base, self.reorder, self.count, self.named = source, base, reorder, 0, None
        P.use_dictionary(source.terms)

    @property
    def spark(self):
        return self.source.spark

    def fresh(self, hint):
        self.count += 1
        return f"__{hint}_{self.count}"

    # expressions
    def value(self, e, env):
        """Val of an expression; env maps a variable name to a Val, aggregates to Vals by their tuple's repr."""
        kind = e[0]
        if kind == "var":
            return env(e[1]) or Val(ANY, F.lit(None).cast("struct<kind:int,lex:string,dt:string,lang:string>"))
        if kind in ("iri", "lit"):
            v = Val.const(e)
            if kind == "lit":
                v.const_text = e[1]
            else:
                v.const_iri = e[1]
            return v
        if kind == "agg":
            return env(repr(e))
        if kind == "triple":
            return Val(ANY, triple_term([self.value(x, env) for x in e[1:]]))
        if kind == "exists":
            return env(repr(e))
        name, args = e[1], e[2]
        if name == "BOUND":
            return Val.boolean(self.value(args[0], env).bound())
        if name == "COALESCE":
            known = [a for a in args if a[0] != "var" or env(a[1]) is not None]
            return call(name, [self.value(a, env) for a in known], self.base) if known else Val(ANY, F.lit(None).cast("struct<kind:int,lex:string,dt:string,lang:string>"))
        return call(name, [self.value(a, env) for a in args], self.base)

    def env(self, plan, more=None):
        def look(name):
            if more and name in more:
                return more[name]
            return plan.val(name) if name in plan.vars else None

        return look

    def decoded(self, plan, exprs):
        """The plan with dictionary ids decoded where an expression needs the value."""
        names = set().union(*[variables(e) for e in exprs]) if exprs else set()
        ids = [v for v in names if plan.vars.get(v) == ID]
        return P.decode(plan, ids, self.source.terms) if ids else plan

    # groups
    def group(self, elements, graph=None, start=None, keep_filters=None):
        """Plan of a group.  With keep_filters (a list) the group's own filters are put there instead of applied."""
        P.use_dictionary(self.source.terms)
        out, filters = start or P.unit(self.spark), []
        for el in self.ordered(elements):
            kind = el[0]
            if kind == "triples":
                out = P.join(out, self.bgp(el[1], graph))
            elif kind == "filter":
                filters.append(el[1])
            elif kind == "optional":
                own = []
                right = self.group(el[1], graph, keep_filters=own)
                out = self.left_join(out, right, own, graph)
            elif kind == "union":
                out = P.join(out, P.union([self.group(g, graph) for g in el[1]]))
            elif kind == "group":
                out = P.join(out, self.group(el[1], graph))
            elif kind == "minus":
                out = P.minus(out, self.group(el[1], graph))
            elif kind == "graph":
                out = P.join(out, self.in_graph(el[1], self.group(el[2], el[1])))
            elif kind == "bind":
                out = self.bind(out, el[1], el[2], graph)
            elif kind == "values":
                out = P.join(out, self.values(el[1], el[2]))
            elif kind == "select":
                out = P.join(out, self.select(el[1], graph))
            elif kind == "service":
                if not el[1]:
                    raise PermissionError("federated queries are not allowed")
        if keep_filters is not None:
            keep_filters.extend(filters)
            return out
        for f in filters:
            out = self.filter(out, f, graph)
        return out

    def ordered(self, elements):
        """Neighbouring triple blocks and sub-groups merged so that joins on shared variables come before cross products."""
        if not self.reorder:
            return elements
        out = []
        for el in elements:
            if el[0] == "triples" and out and out[-1][0] == "triples":
                out[-1] = ("triples", out[-1][1] + el[1])
            elif el[0] == "filter":
                out.append(el)
            elif el[0] == "triples" and out and out[-1][0] == "filter" and (at := next((i for i in range(len(out) - 1, -1, -1) if out[i][0] != "filter"), None)) is not None and out[at][0] == "triples":
                out[at] = ("triples", out[at][1] + el[1])
            else:
                out.append(el)
        return out

    def left_join(self, left, right, filters, graph):
        if not filters:
            return P.join(left, right, "left")
        names = [f for f in filters if not find_exists(f)]
        for f in filters:
            if find_exists(f):
                right = self.filter(right, f, graph)
        left, right = self.decoded(left, names), self.decoded(right, names)
        for v in [v for v in left.vars if v in right.vars and ANY in (left.vars[v], right.vars[v]) and ID in (left.vars[v], right.vars[v])]:
            left, right = P.decode(left, [v], self.source.terms), P.decode(right, [v], self.source.terms)

        def cond(both, merged):
            def look(name):
                if name not in both.vars:
                    return None
                rep = both.vars[name]
                return Val(rep, *[merged.get(c, F.col(c)) for c in columns(name, rep)])

            out = None
            for f in names:
                c = self.value(f, look).truth()
                out = c if out is None else out & c
            return out

        return P.join(left, right, "left", cond if names else None)

    def filter(self, plan, e, graph=None):
        for c in conjuncts(e):
            if c[0] == "exists":
                plan = self.exists(plan, c, graph)
                continue
            if c[0] == "call" and c[1] == "NOT" and c[2][0][0] == "exists":
                plan = self.exists(plan, ("exists", c[2][0][1], not c[2][0][2]), graph)
                continue
            plan, more = self.marks(plan, c, graph)
            plan = self.decoded(plan, [c])
            kept = plan.filter(self.value(c, self.env(plan, more)).truth())
            plan = kept.only(list(plan.vars)) if more else kept
        return plan

    def exists(self, plan, e, graph):
        inner = []
        body = self.group(e[1], graph, keep_filters=inner)
        late = [f for f in inner if variables(f) - set(body.vars) and variables(f) & set(plan.vars)]
        for f in inner:
            if f not in late:
                body = self.filter(body, f, graph)
        if not late:
            return P.semi(plan, body, e[2])
        # filters that see the outer solution: distinct outer keys joined with the body, filtered, then matched
        outer = sorted((set().union(*[variables(f) for f in late]) | set(body.vars)) & set(plan.vars))
        keys = plan.only(outer)
        keys = Plan(keys.df.distinct(), keys.vars, keys.must)
        hit = P.join(keys, body)
        for f in late:
            hit = self.filter(hit, f, graph)
        hit = hit.only(outer)
        return P.semi(plan, Plan(hit.df.distinct(), hit.vars, hit.must), e[2])

    def marks(self, plan, e, graph):
        """EXISTS inside a larger expression: a flag column each, from a left join with distinct keys."""
        more = {}
        for x in find_exists(e):
            body = self.group(x[1], graph)
            shared = [v for v in plan.vars if v in body.vars]
            flag = self.fresh("flag")
            if not shared:
                body = Plan(body.df.limit(1).select(F.lit(True).alias(columns(flag, literal(XSD + "boolean"))[0])), {flag: literal(XSD + "boolean")})
            else:
                body = body.only(shared)
                body = Plan(body.df.distinct(), body.vars, body.must).with_vals({flag: Val.boolean(F.lit(True))})
            plan = P.join(plan, body, "left")
            found = F.coalesce(plan.val(flag).col, F.lit(False))
            more[repr(x)] = Val.boolean(~found if x[2] else found)
        return plan, more

    def bind(self, plan, e, var, graph=None):
        if var in plan.vars:
            raise ValueError(f"?{var} is already in use")
        plan, more = self.marks(plan, e, graph)
        if e[0] == "var" and e[1] in plan.vars:
            return plan.with_vals({var: plan.val(e[1])}, {var} if e[1] in plan.must else ())
        plan = self.decoded(plan, [e])
        val = self.value(e, self.env(plan, more))
        out = plan.with_vals({var: val}, {var} if e[0] in ("iri", "lit") else ())
        return out.only([v for v in out.vars if not v.startswith("__flag")])

    def values(self, names, rows):
        reps = {}
        for i, n in enumerate(names):
            own = [Val.const(r[i]).rep for r in rows if r[i]]
            rep = own[0] if own else WHOLE
            for r in own[1:]:
                rep = common(rep, r)
            reps[n] = rep
        df = None
        for r in rows:
            cells = []
            for n, t in zip(names, r):
                rep = reps[n]
                if t is not None:
                    cells.append(convert(Val.const(t), rep).col.alias(columns(n, rep)[0]))
                else:
                    like = next((convert(Val.const(q[names.index(n)]), rep).col for q in rows if q[names.index(n)]), F.lit("x"))
                    cells.append(F.when(F.lit(False), like).alias(columns(n, rep)[0]))
            one = self.spark.range(1).select(*cells)
            df = one if df is None else df.unionAll(one)
        if df is None:
            df = self.spark.range(0).select(*[F.lit(None).cast("string").alias(columns(n, WHOLE)[0]) for n in names])
        return Plan(df, reps, frozenset(n for i, n in enumerate(names) if all(r[i] for r in rows)))

    # basic graph patterns and paths
    def bgp(self, triples, graph):
        stars, paths = {}, []
        for s, p, o in triples:
            if p[0] == "link":
                p = ("iri", p[1])
            if p[0] in ("iri", "var"):
                stars.setdefault(s, []).append((p, o))
            else:
                paths.append((s, p, o))
        parts = [(set(variables(s)) | {v for p, o in po for v in variables(p) | variables(o)}, min(self.source.weight((s, p, o)) for p, o in po), lambda s=s, po=po: self.source.star(s, po, graph)) for s, po in stars.items()]
        parts += [(variables(s) | variables(o), 9, lambda s=s, p=p, o=o: self.path(s, p, o, graph)) for s, p, o in paths]
        out, seen = None, set()
        while parts:
            linked = [x for x in parts if x[0] & seen] or parts
            best = min(linked, key=lambda x: x[1]) if self.reorder else linked[0]
            parts.remove(best)
            plan = best[2]()
            out, seen = plan if out is None else P.join(out, plan), seen | best[0]
        return out or P.unit(self.spark)

    def path(self, s, p, o, graph):
        """Solutions of one path pattern."""
        pairs = self.pairs(p, graph, s if s[0] != "var" else None, o if o[0] != "var" else None)
        if s == o and s[0] == "var":
            rep = common(pairs.vars["__s"], pairs.vars["__o"])
            a, b = convert(pairs.val("__s"), rep), convert(pairs.val("__o"), rep)
            cond = a.cols[0] == b.cols[0]
            for x, y in zip(a.cols[1:], b.cols[1:]):
                cond = cond & (x == y)
            return pairs.filter(cond).with_vals({s[1]: pairs.val("__s")}, {s[1]}).only([s[1], *self.graph_var(graph)])
        vals = {}
        for t, at in ((s, "__s"), (o, "__o")):
            if t[0] == "var":
                vals[t[1]] = pairs.val(at)
            else:
                pairs = pairs.filter(self.is_term(pairs.val(at), t))
        return pairs.with_vals(vals, set(vals)).only([*vals, *self.graph_var(graph)]) if vals else Plan(pairs.df.select(F.lit(1).alias("q_one")))

    @staticmethod
    def graph_var(graph):
        return [graph[1]] if graph and graph[0] == "var" else []

    @staticmethod
    def is_term(val, t):
        if val.rep.kind == "id":
            return val.col == Val.const(t).id()
        c = Val.const(t)
        if val.rep.kind == c.rep.kind == "iri":
            return val.iri() == c.col
        return val.term() == c.term()

    def swap(self, plan):
        a, b = plan.val("__s"), plan.val("__o")
        return plan.with_vals({"__s": b, "__o": a}, {"__s", "__o"})

    def pairs(self, p, graph, s=None, o=None):
        """Pairs (__s, __o) of a path; s and o are constant ends, used to start closures."""
        kind = p[0]
        ends = ["__s", "__o", *self.graph_var(graph)]
        if kind == "link":
            return self.source.star(("var", "__s"), [(("iri", p[1]), ("var", "__o"))], graph)
        if kind == "inv":
            return self.swap(self.pairs(p[1], graph, o, s))
        if kind == "seq":
            left, right = self.pairs(p[1], graph, s, None), self.pairs(p[2], graph, None, o)
            left = left.with_vals({"__m": left.val("__o")}, {"__m"}).only(["__s", "__m", *self.graph_var(graph)])
            right = right.with_vals({"__m": right.val("__s")}, {"__m"}).only(["__m", "__o", *self.graph_var(graph)])
            return P.join(left, right).only(ends)
        if kind == "alt":
            return P.union([self.pairs(q, graph, s, o).only(ends) for q in p[1:]])
        if kind == "neg":
            arms = []
            for inverse in (False, True):
                no = [i for i, inv in p[1] if bool(inv) == inverse]
                if no or not inverse and not any(inv for _, inv in p[1]):
                    t = self.source.star(("var", "__s"), [(("var", "__p"), ("var", "__o"))], graph)
                    v = t.val("__p")
                    bad = F.lit(False)
                    for i in no:
                        bad = bad | self.is_term(v, ("iri", i))
                    t = t.filter(~bad).only(ends)
                    arms.append(self.swap(t) if inverse else t)
            return P.union(arms)
        if kind == "opt":
            return self.distinct(P.union([self.same(graph, s, o), self.pairs(p[1], graph, s, o).only(ends)]))
        if kind == "star":
            return self.distinct(P.union([self.same(graph, s, o), self.plus(p[1], graph, s, o)]))
        if kind == "plus":
            return self.plus(p[1], graph, s, o)
        if kind == "rep":
            low, high = p[2], p[3]
            arms = []
            for n in range(low, (high if high is not None else low) + 1):
                if n == 0:
                    arms.append(self.same(graph, s, o) if high is not None else None)
                    continue
                q = p[1]
                for _ in range(n - 1):
                    q = ("seq", q, p[1])
                arms.append(self.pairs(q, graph, s, o).only(ends))
            if high is None:
                rest = ("star", p[1])
                return self.pairs(rest if low == 0 else ("seq", _times(p[1], low), rest), graph, s, o)
            return P.union([a for a in arms if a])
        raise ValueError(f"unknown path {kind}")

    def distinct(self, plan):
        return Plan(plan.df.distinct(), plan.vars, plan.must)

    def same(self, graph, s, o):
        """Zero-length pairs: a constant end itself, else every node of the graph."""
        if s or o:
            a, b = Val.const(s or o), Val.const(o or s)
            cols = [x.alias(c) for n, v in (("__s", a), ("__o", b)) for x, c in zip(v.cols, columns(n, v.rep))]
            df = self.spark.range(1).select(*cols)
            plan = Plan(df, {"__s": a.rep, "__o": b.rep}, frozenset({"__s", "__o"}))
            return plan if not (s and o) or s == o else plan.empty()
        t = self.source.star(("var", "__s"), [(("var", "__p"), ("var", "__o"))], graph)
        g = self.graph_var(graph)
        ends = P.union([t.only(["__s", *g]), t.with_vals({"__s": t.val("__o")}, {"__s"}).only(["__s", *g])])
        ends = self.distinct(ends)
        return ends.with_vals({"__o": ends.val("__s")}, {"__s", "__o"})

    def plus(self, p, graph, s, o):
        pairs = self.pairs(p, graph)
        rep = common(pairs.vars["__s"], pairs.vars["__o"])
        if rep.width > 1:
            rep = WHOLE
        named = columns(graph[1], pairs.vars[graph[1]]) if self.graph_var(graph) else []
        node = lambda c: F.struct(*named, c.alias("n")) if named else c  # noqa: E731  in GRAPH ?g a node is one of its graph
        edges = pairs.df.select(*[node(convert(pairs.val(v), rep).col).alias(n) for v, n in (("__s", "s"), ("__o", "o"))])
        fixed = s or o
        start = None
        if fixed:
            if s is None:
                edges = edges.select(F.col("o").alias("s"), F.col("s").alias("o"))
            start = edges.where(self.is_term(Val(rep, F.col("s.n") if named else F.col("s")), fixed)).select("s")
        reach = closure(edges, start)
        if fixed and s is None:
            reach = reach.select(F.col("o").alias("s"), F.col("s").alias("o"))
        c = columns("__s", rep)[0], columns("__o", rep)[0]
        if named:
            kinds = {"__s": rep, "__o": rep, graph[1]: pairs.vars[graph[1]]}
            return Plan(reach.select(F.col("s.n").alias(c[0]), F.col("o.n").alias(c[1]), *[F.col("s")[x].alias(x) for x in named]), kinds, frozenset(kinds))
        return Plan(reach.select(F.col("s").alias(c[0]), F.col("o").alias(c[1])), {"__s": rep, "__o": rep}, frozenset({"__s", "__o"}))

    # aggregation and modifiers
    def aggregate(self, plan, q, graph):
        """Plan of the grouped query with an env for its aggregates."""
        keys = []
        for name, e in q["group"] or []:
            if e is not None:
                plan = self.bind(plan, e, name, graph)
            elif name not in plan.vars:
                plan = plan.with_vals({name: Val(WHOLE, F.lit(None).cast("string"))})
            keys.append(name)
        wanted = {repr(a): a for e in [*[e for _, e in q["project"] or [] if e], *q["having"], *[e for e, _ in q["order"]]] for a in aggregates(e)}
        plan = self.decoded(plan, [a[3] for a in wanted.values() if a[3] is not None and not (a[1] == "COUNT" and a[3][0] == "var")])
        for a in wanted.values():
            if a[3] is not None:
                plan, _ = self.marks(plan, a[3], graph)
        exprs, made = [], {}
        for n, (key, a) in enumerate(wanted.items()):
            cols, finish = self.aggregate_columns(plan, a)
            named = {f"q_a{n}_{i}": c for i, c in enumerate(cols)}
            exprs += [c.alias(k) for k, c in named.items()]
            made[key] = finish(*[F.col(k) for k in named])
        key_cols = [c for k in keys for c in columns(k, plan.vars[k])]
        exprs = exprs or [F.count(F.lit(1)).alias("q_unused")]
        df = plan.df.groupBy(*key_cols).agg(*exprs) if q["group"] else plan.df.agg(*exprs)
        vals = {f"__agg{n}": v for n, v in enumerate(made.values())}
        out = Plan(df, {k: plan.vars[k] for k in keys}, plan.must & set(keys)).with_vals(vals)
        names = dict(zip(made, vals))
        return out, names

    def aggregate_columns(self, plan, a):
        """(aggregate columns, function from them to the Val) of one aggregate."""
        _, name, distinct, e, sep = a
        if e is None:
            if distinct:
                every = [c for v, r in plan.vars.items() for c in columns(v, r)]
                return [F.count_distinct(F.struct(*every))], Val.integer
            return [F.count(F.lit(1))], Val.integer
        v = self.value(e, self.env(plan))
        first = v.cols[0]
        if name == "COUNT":
            return [F.count_distinct(*v.cols) if distinct else F.count(first)], Val.integer
        if name in ("SUM", "AVG"):
            if v.rank == 0:
                return [F.max(F.lit(None).cast("bigint"))], lambda c: Val(literal(XSD + "integer"), c)
            if v.rank is None:
                x, ranks = v.number().cast("double"), v.ranks()
                total = F.sum_distinct(x) if distinct else F.sum(x)
                n = F.count_distinct(x) if distinct else F.count(x)
                whole = F.when(ranks == 1, v.lex().try_cast("decimal(20,0)"))  # integers are added exactly, not as doubles
                cols = [total, n, F.max(ranks), F.count(first), F.count(x), F.sum_distinct(whole) if distinct else F.sum(whole)]

                def finish(t, n, r, bound, numeric, i):
                    ok = bound == numeric
                    if name == "SUM":
                        exact = Val(ANY, F.when(i.try_cast("bigint").isNotNull(), term(LIT, i.cast("string"), F.lit(XSD + "integer"))))
                        some = dynamic_number(F.when(ok, F.coalesce(r, F.lit(1))), F.coalesce(t, F.lit(0.0)))
                        return Val(ANY, F.when(ok & (r == 1), exact.col).otherwise(some.col))
                    return dynamic_number(F.when(ok, F.greatest(F.coalesce(r, F.lit(2)), F.lit(2))), F.coalesce(F.try_divide(t, n.cast("double")), F.lit(0.0)))

                return cols, finish
            x = v.col if v.rank != 1 else v.col.cast("decimal(20,0)")
            total = F.sum_distinct(x) if distinct else F.try_sum(x)
            if name == "SUM":  # nothing gives 0, a sum out of range is an error
                kind = {1: "bigint", 2: "decimal(38,10)"}.get(v.rank, "double")
                return [total, F.count(x)], lambda c, n: Val(v.rep, F.when(n == 0, F.lit(0).cast(kind)).otherwise(c.try_cast(kind)))
            if v.rank > 2:
                return [F.try_avg(F.when(F.lit(True), x)) if not distinct else total / F.count_distinct(x)], lambda c: Val(v.rep, F.coalesce(c, F.lit(0.0)))
            n = F.count_distinct(x) if distinct else F.count(x)
            return [total, n], lambda t, n: Val(literal(XSD + "decimal"), F.coalesce(arithmetic("/", Val(literal(XSD + "decimal"), t.cast("decimal(38,10)")), Val.integer(n)).col.cast("decimal(38,10)"), F.lit(0).cast("decimal(38,10)")))
        if name in ("MIN", "MAX", "SAMPLE"):
            f = F.max if name == "MAX" else F.min
            by = F.max_by if name == "MAX" else F.min_by
            if v.rep.kind == "lit":
                return [f(v.col)], lambda c: Val(v.rep, c)
            if v.rep.kind == "iri":
                return [f(v.iri())], lambda c: Val(WHOLE, c)
            key = F.struct(v.number().cast("double").isNull().alias("n"), v.number().cast("double").alias("x"), v.lex().alias("l"))
            return [by(v.col, key)], lambda c: Val(ANY, c)
        if name == "GROUP_CONCAT":
            x = v.lex()
            got = F.sort_array(F.collect_set(x) if distinct else F.collect_list(x))
            return [got], lambda c: Val.string(F.array_join(c, sep))
        raise ValueError(f"unknown aggregate {name}")

    def order_keys(self, e, down, env):
        v = self.value(e, env)
        if v.rep.kind == "lit":
            keys = [v.col]
        elif v.rep.kind == "iri":
            keys = [v.iri()]
        else:
            rank = F.when(v.kind() == BNODE, 1).when(v.kind() == IRI, 2).when(v.kind() == LIT, 3).when(v.kind() == TRIPLE, 4)
            keys = [rank, v.number().cast("double"), v.lex()]
        return [k.desc_nulls_last() if down else k.asc_nulls_first() for k in keys]

    def select(self, q, graph=None, outer=True):
        """Plan of a SELECT query."""
        graph = self.dataset(q, graph)
        plan = self.group(q["where"], graph)
        if q.get("values"):
            plan = P.join(plan, self.values(*q["values"][1:]))
        grouped = q["group"] is not None or any(aggregates(e) for e in [*[e for _, e in q["project"] or [] if e], *q["having"]])
        more = {}
        if grouped:
            if q["project"] is None:
                raise ValueError("SELECT * can't be grouped")
            plan, names = self.aggregate(plan, q, graph)
            more = names
        aliased = lambda p: self.env(p, {k: p.val(v) for k, v in more.items() if v in p.vars})
        for e in q["having"]:
            plan = self.decoded(plan, [e])
            plan = plan.filter(self.value(e, aliased(plan)).truth())
        for name, e in q["project"] or []:
            if e is not None:
                plan, flags = self.marks(plan, e, graph)
                plan = self.decoded(plan, [e])
                look = aliased(plan)
                val = self.value(e, lambda n, look=look, flags=flags: flags.get(n) or look(n))
                sure = {name} if e[0] == "agg" and e[1] in ("COUNT", "SUM", "GROUP_CONCAT") or e[0] == "var" and e[1] in plan.must else set()
                plan = plan.with_vals({name: val}, sure)
        shown = [v for v in plan.vars if not v.startswith("__")] if q["project"] is None else [n for n, _ in q["project"]]
        if grouped and (loose := [n for n, e in q["project"] if e is None and n not in plan.vars and n not in {k for k, _ in q["group"] or []}]):
            raise ValueError(f"?{loose[0]} is neither grouped nor aggregated")
        plan = plan.with_vals({n: Val(WHOLE, F.lit(None).cast("string")) for n in shown if n not in plan.vars})
        if q["distinct"]:
            plan = self.distinct(plan.only(shown))
        if q["order"]:
            # what is shown is decoded first: a join after the sort would lose its order
            plan = self.decoded(plan, [*[e for e, _ in q["order"]], *[("var", v) for v in shown]])
            look = aliased(plan)
            keys = [k for e, down in q["order"] for k in self.order_keys(e, down, look)]
            plan = Plan(plan.df.orderBy(*keys), plan.vars, plan.must)
        plan = plan.only(shown)
        if q["offset"]:
            plan = Plan(plan.df.offset(q["offset"]), plan.vars, plan.must)
        if q["limit"] is not None:
            plan = Plan(plan.df.limit(q["limit"]), plan.vars, plan.must)
        return plan

    def in_graph(self, graph, plan):
        """The solutions of a GRAPH group that lie in the query's FROM NAMED graphs, where it has a dataset."""
        if self.named is None:
            return plan
        if graph[0] == "iri":
            return plan if graph[1] in self.named else plan.empty()
        if graph[1] not in plan.vars:
            return plan
        known = plan.val(graph[1]).id() if plan.vars[graph[1]] == ID else plan.val(graph[1]).iri()
        wanted = [Val.const(("iri", g)).id() if plan.vars[graph[1]] == ID else F.lit(g) for g in self.named]
        return plan.filter(known.isin(*wanted)) if wanted else plan.empty()

    def dataset(self, q, graph):
        if q.get("from") or q.get("named"):
            self.named = list(q.get("named") or [])
            return ("set", list(q.get("from") or []))
        return graph

    # query forms
    def run(self, q, output="values"):
        """DataFrame of a parsed query: plain values, or N-Triples texts with output="terms"."""
        form = q["form"]
        if form == "SELECT":
            return self.result(self.select(q), output)
        if form == "ASK":
            plan = self.group(q["where"], self.dataset(q, None))
            return plan.df.limit(1).agg((F.count(F.lit(1)) > 0).alias("ask"))
        if form == "CONSTRUCT":
            inner = {"form": "SELECT", "distinct": False, "project": None} | {k: q[k] for k in ("where", "from", "named", "group", "having", "order", "limit", "offset", "values")}
            return self.construct(self.select(inner), q["template"]).select("s", "p", "o").distinct()
        return self.describe(q)

    def result(self, plan, output="values"):
        names = list(plan.vars)
        plan = P.decode(plan, names, self.source.terms) if ID in plan.vars.values() else plan
        vals = [(v, plan.val(v)) for v in names]
        if not vals:
            return plan.df.select(F.lit(None).cast("string").alias("_")) if not plan.df.columns else plan.df
        return plan.df.select(*[(x.native() if output == "values" else x.nt()).alias(v) for v, x in vals])

    def construct(self, plan, template, quads=False):
        """Rows (s, p, o[, g]) of N-Triples texts of a template; incomplete and ill-formed triples are dropped."""
        names = {v for t in template for v in variables([x for x in t if x])}
        plan = P.decode(plan, [v for v in names if v in plan.vars], self.source.terms) if ID in plan.vars.values() else plan
        df = plan.df.withColumn("q_row", F.monotonically_increasing_id()) if any(v.startswith("__bn") and v not in plan.vars for v in names) else plan.df

        def text(t):
            if t is None:
                return F.lit("")
            if t[0] == "link":
                t = ("iri", t[1])
            if t[0] == "var":
                if t[1] in plan.vars:
                    return plan.val(t[1]).nt()
                return F.concat(F.lit("_:c"), F.hex(F.xxhash64("q_row", F.lit(t[1])))) if t[1].startswith("__bn") else F.lit(None).cast("string")
            return Val.const(t).nt()

        rows = F.array(*[F.struct(text(s).alias("s"), text(p).alias("p"), text(o).alias("o"), text(g).alias("g")) for s, p, o, g in template])
        out = df.select(F.explode(rows).alias("t")).select("t.s", "t.p", "t.o", "t.g")
        return out.where("s is not null and p is not null and o is not null and g is not null and p like '<%' and (s like '<%' or s like '\\_:%')")

    def describe(self, q):
        parts = []
        where = self.group(q["where"], self.dataset(q, None)) if q["where"] else None
        for t in q["terms"] if q["terms"] is not None else [("var", v) for v in (where.vars if where else ()) if not v.startswith("__")]:
            triples = self.source.star(("var", "s") if t[0] == "var" else t, [(("var", "p"), ("var", "o"))], ("any",) if self.source.terms is not None else None)
            if t[0] == "var":
                nodes = where.with_vals({"s": where.val(t[1])}, where.must & {"s"}).only(["s"])
                triples = P.semi(triples, nodes)
            else:
                triples = triples.with_vals({"s": Val.const(t)}, {"s"})
            parts.append(self.result(triples.only(["s", "p", "o"]), "terms"))
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out.distinct()


def _times(p, n):
    out = p
    for _ in range(n - 1):
        out = ("seq", out, p)
    return out


def triple_term(vals):
    """Term struct of a triple term: its lexical form is the N-Triples text."""
    text = F.concat_ws(" ", F.lit("<<("), *[v.nt() for v in vals], F.lit(")>>"))
    ok = vals[0].bound()
    for v in vals[1:]:
        ok = ok & v.bound()
    return F.when(ok, term(TRIPLE, text))


def sparql(source, text, prefixes=None, base=None, output="values", reorder=True):
    """DataFrame of a query text over a source."""
    return Compiler(source, base, reorder).run(parse_query(text, prefixes, base), output)


__all__ = ["Compiler", "Rep", "sparql", "variables"]
