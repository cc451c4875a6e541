"""Solution sets as DataFrames: joins, unions and differences under SPARQL's compatibility rules."""

import contextvars
from dataclasses import dataclass, field

from pyspark.sql import functions as F

from ..functions.terms import ANY, ID, Val, common, convert, disjoint


def columns(var, rep):
    """DataFrame column names of a variable."""
    return [f"q{i}_{var}" for i in range(rep.width)]


@dataclass
class Plan:
    """df has the columns of every variable in vars; a null first column is unbound, impossible for those in must."""

    df: object
    vars: dict = field(default_factory=dict)
    must: frozenset = frozenset()

    def val(self, var):
        rep = self.vars[var]
        return Val(rep, *[F.col(c) for c in columns(var, rep)])

    def with_vals(self, vals, must=()):
        """This plan with further (or replaced) variables from Vals over its columns."""
        new = {v: val.rep for v, val in vals.items()}
        df = self.df.withColumns({c: col for v, val in vals.items() for c, col in zip(columns(v, val.rep), val.cols)})
        keep = [c for v, r in (self.vars | new).items() for c in columns(v, r)]
        return Plan(df.select(*keep), self.vars | new, (self.must - set(new)) | frozenset(must))

    def only(self, names):
        """The plan with just these variables."""
        vars_ = {v: self.vars[v] for v in names if v in self.vars}
        return Plan(self.df.select(*[c for v, r in vars_.items() for c in columns(v, r)]), vars_, self.must & set(vars_))

    def filter(self, cond):
        return Plan(self.df.filter(cond), self.vars, self.must)

    def empty(self):
        return Plan(self.df.limit(0), self.vars, self.must)


def unit(spark):
    """The one empty solution."""
    return Plan(spark.range(1).select(F.lit(1).alias("q_one")))


def is_unit(p):
    return not p.vars and "q_one" in p.df.columns


_DICTIONARY = contextvars.ContextVar("dictionary", default=None)


def use_dictionary(terms):
    """The dictionary that ids are decoded with where they meet computed terms; each thread has its own."""
    _DICTIONARY.set(terms)


def bridge(a, b, shared):
    """Both plans ready to join where a variable is an id on one side and a computed term on the other.

    A computed term that is bound for sure is compared by its id and keeps its own columns, so nothing is decoded; otherwise
    the ids are decoded.
    """
    for v in shared:
        ka, kb = a.vars[v] == ID, b.vars[v] == ID
        if ka == kb:
            continue
        h = f"__j_{v}"
        if kb and v in a.must:
            a = a.with_vals({h: Val(ID, a.val(v).id())}, {h})
            b = b.with_vals({h: b.val(v)}, {h} & ({h} if v in b.must else set())).only([x for x in (*b.vars, h) if x != v])
        elif ka and v in a.must and v in b.must:
            a = a.with_vals({h: a.val(v)}, {h})
            b = b.with_vals({h: Val(ID, b.val(v).id())}, {h}).only([x for x in (*b.vars, h) if x != v])
        else:
            a, b = decode(a, [v], _DICTIONARY.get()), decode(b, [v], _DICTIONARY.get())
    return a, b


def unbridged(plan):
    return plan.only([v for v in plan.vars if not v.startswith("__j_")]) if any(v.startswith("__j_") for v in plan.vars) else plan


def as_rep(plan, var, rep):
    return plan if plan.vars[var] == rep else plan.with_vals({var: convert(plan.val(var), rep)}, plan.must & {var})


def align(a, b, names):
    """Both plans with each shared variable in a common Rep; None when a must-bound variable has disjoint Reps."""
    for v in names:
        if v in a.must and v in b.must and disjoint(a.vars[v], b.vars[v]):
            return None
        rep = common(a.vars[v], b.vars[v])
        a, b = as_rep(a, v, rep), as_rep(b, v, rep)
    return a, b


def _sided(a, b, shared):
    """The plans with the shared columns of b renamed, and the name map."""
    ren = {c: f"r_{c}" for v in shared for c in columns(v, b.vars[v])}
    return b.df.withColumnsRenamed(ren), ren


def _agree(var, rep, sure, ren):
    cols = columns(var, rep)
    eq = F.col(cols[0]) == F.col(ren[cols[0]])
    for c in cols[1:]:
        eq = eq & (F.col(c) == F.col(ren[c]))
    return eq if sure else F.col(cols[0]).isNull() | F.col(ren[cols[0]]).isNull() | eq


def join(a, b, how="inner", extra=None):
    """Compatibility join; how is inner or left.  extra(plan) is a condition over the joined solution (OPTIONAL's filter)."""
    if is_unit(a) and how == "inner":
        return b
    if is_unit(b):
        return a
    a, b = bridge(a, b, [v for v in a.vars if v in b.vars])
    return unbridged(_join(a, b, how, extra))


def _join(a, b, how, extra):
    shared = [v for v in a.vars if v in b.vars]
    both = align(a, b, shared)
    must_l, must_r = a.must, b.must
    if both is None:
        if how == "inner":
            vars_ = a.vars | b.vars
            df = a.df.limit(0)
            for v, r in b.vars.items():
                if v not in a.vars:
                    df = df.withColumns({c: F.lit(None).cast(dict(b.df.dtypes)[c]) for c in columns(v, r)})
            return Plan(df.select(*[c for v, r in vars_.items() for c in columns(v, r)]), vars_, a.must | b.must)
        new = {c: F.lit(None).cast(dict(b.df.dtypes)[c]) for v, r in b.vars.items() if v not in a.vars for c in columns(v, r)}
        return Plan(a.df.withColumns(new), a.vars | {v: r for v, r in b.vars.items() if v not in a.vars}, a.must)
    a, b = both
    right, ren = _sided(a, b, shared)
    sure = {v for v in shared if v in must_l and v in must_r}
    cond = None
    for v in shared:
        c = _agree(v, a.vars[v], v in sure, ren)
        cond = c if cond is None else cond & c
    left = a.df
    vars_ = a.vars | b.vars
    if extra is not None:
        # the filter sees the merged solution: shared variables may be bound on the right only
        merged = {c: F.coalesce(F.col(c), F.col(ren[c])) for v in shared if v not in must_l for c in columns(v, a.vars[v])}
        e = extra(Plan(None, vars_, must_l | must_r), merged)
        cond = e if cond is None else cond & e
    if cond is None:
        df = left.crossJoin(right) if how == "inner" else left.join(right, F.lit(True), how)
    else:
        df = left.join(right, cond, how)
    df = df.withColumns({c: F.coalesce(F.col(c), F.col(ren[c])) for v in shared if v not in must_l for c in columns(v, a.vars[v])})
    out = [c for v, r in vars_.items() for c in columns(v, r)]
    return Plan(df.select(*out), vars_, must_l | must_r if how == "inner" else must_l)


def union(plans):
    """Bag union; a variable that an arm lacks is unbound there."""
    if len(plans) == 1:
        return plans[0]
    kinds = {}
    for p in plans:
        for v, r in p.vars.items():
            kinds.setdefault(v, set()).add(r == ID)
    mixed = [v for v, k in kinds.items() if len(k) > 1]
    if mixed:
        plans = [decode(p, mixed, _DICTIONARY.get()) for p in plans]
    reps = {}
    for p in plans:
        for v, r in p.vars.items():
            reps[v] = common(reps[v], r) if v in reps else r
    out = None
    for p in plans:
        for v in list(p.vars):
            p = as_rep(p, v, reps[v])
        df = p.df.select(*[c for v, r in p.vars.items() for c in columns(v, r)]) if p.vars else p.df.select(F.lit(1).alias("q_one"))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    must = frozenset.intersection(*[frozenset(p.must) for p in plans])
    cols = [c for v, r in reps.items() for c in columns(v, r)]
    return Plan(out.select(*cols) if cols else out.select(F.lit(1).alias("q_one")), reps, must)


def minus(a, b):
    """Solutions of a without a compatible solution of b that shares a bound variable."""
    shared = [v for v in a.vars if v in b.vars]
    if not shared:
        return a
    own = list(a.vars)
    a, b = bridge(a, b.only(shared), shared)
    shared = [v for v in a.vars if v in b.vars]
    both = align(a, b.only(shared), shared)
    if both is None:
        return a.only(own)
    x, y = both
    right, ren = _sided(x, y, shared)
    sure = [v for v in shared if v in a.must and v in b.must]
    cond = overlap = None
    for v in shared:
        c = _agree(v, x.vars[v], v in sure, ren)
        cond = c if cond is None else cond & c
        first = columns(v, x.vars[v])[0]
        o = F.col(first).isNotNull() & F.col(ren[first]).isNotNull()
        overlap = o if overlap is None else overlap | o
    if not sure:
        cond = cond & overlap
    return Plan(x.df.join(right.distinct() if sure else right, cond, "left_anti"), x.vars, a.must).only(own)


def semi(a, b, anti=False):
    """EXISTS or NOT EXISTS of b, correlated on the shared variables."""
    shared = [v for v in a.vars if v in b.vars]
    how = "left_anti" if anti else "left_semi"
    own = list(a.vars)
    if shared:
        a, b = bridge(a, b.only(shared), shared)
        shared = [v for v in a.vars if v in b.vars]
    both = align(a, b.only(shared), shared) if shared else (a, b)
    if both is None:
        return a.only(own) if anti else a.only(own).empty()
    x, y = both
    if not shared:
        return Plan(x.df.join(y.df.select(F.lit(1).alias("r_one")).limit(1), F.lit(True), how), x.vars, a.must)
    right, ren = _sided(x, y, shared)
    cond = None
    for v in shared:
        c = _agree(v, x.vars[v], v in a.must and v in b.must, ren)
        cond = c if cond is None else cond & c
    return Plan(x.df.join(right, cond, how), x.vars, a.must).only(own)


#: Bytes of a dictionary's files that a partition of its join holds.
DICTIONARY_BYTES = 8 << 20


def dictionary(terms):
    """Rows (r_id, r_term) to look up; one too large to broadcast is hashed in parts, past which solutions stream unsorted."""
    look = terms.select(F.col("id").alias("r_id"), F.col("term").alias("r_term"))
    size = int(str(look._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size <= terms.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold():
        return look
    n = size // DICTIONARY_BYTES + 1
    at_least = int(terms.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (look.repartition(n, "r_id") if n > at_least else look).hint("shuffle_hash")


def decode(plan, names, terms):
    """Dictionary ids of these variables replaced by terms: one join with the dictionary each."""
    names = [v for v in names if plan.vars.get(v) == ID]
    look = dictionary(terms) if names else None
    for v in names:
        if plan.vars.get(v) == ID:
            c = columns(v, ID)[0]
            df = plan.df.join(look, F.col(c) == F.col("r_id"), "inner" if v in plan.must else "left")
            keep = [F.col(x) for u, r in plan.vars.items() if u != v for x in columns(u, r)]
            plan = Plan(df.select(*keep, F.col("r_term").alias(columns(v, ANY)[0])), {u: r for u, r in plan.vars.items() if u != v} | {v: ANY}, plan.must)
    return plan
