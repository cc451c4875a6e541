"""Relational tables as virtual RDF: a mapping, and star patterns as single scans.

Each table gives its rows a subject IRI from a template over key columns, classes, and one property per column.  Patterns
on one subject collapse into one scan of the table; that is sound because the key is unique, which `check_keys`
verifies.  Nothing is turned into triples unless a pattern has a variable predicate.
"""

from dataclasses import dataclass, field

from pyspark.sql import functions as F

from ..functions.names import TYPE
from ..functions.terms import ANY, WHOLE, Rep, Val, convert, literal, spark_dt, template_keys
from ..plans.plan import Plan, columns, union


@dataclass
class Table:
    """One mapped table; props maps a property IRI to (Rep, column names)."""

    name: str
    df: object
    template: str
    keys: list
    classes: list = field(default_factory=list)
    props: dict = field(default_factory=dict)

    @property
    def subject(self):
        return Rep("iri", self.template)


def map_table(df, base, name, keys=None, cls=None, links=None):
    """A Table with subject <base><name>/{key}, class <base><cls> and a property <base><column> for each column.

    links maps a further property name to (template under base, columns) for references to other tables' subjects.
    Without keys the whole row is the identity.
    """
    kinds = dict(df.dtypes)
    keys = keys or df.columns
    props = {base + c: (literal(spark_dt(k)), [c]) for c, k in kinds.items() if not k.startswith(("array", "map", "struct"))}
    props |= {base + p: (Rep("iri", base + t), list(cols)) for p, (t, cols) in (links or {}).items()}
    return Table(name, df, base + name + "/" + "/".join(["{}"] * len(keys)), list(keys), [base + cls] if cls else [], props)


def _is_const(t):
    return t[0] in ("iri", "lit", "triple")


class MappedSource:
    """Patterns over mapped tables; everything is in the default graph."""

    terms = None

    def __init__(self, spark, tables):
        self.spark, self.tables = spark, list(tables)

    def check_keys(self):
        """Raise if a subject key isn't unique: collapsing stars over it would lose rows."""
        for t in self.tables:
            if t.df.groupBy(*t.keys).count().where("count > 1").limit(1).count():
                raise ValueError(f"key {t.keys} of {t.name} isn't unique")

    def access(self, s, p, o):
        """(access path, most rows) of a triple pattern: the tables that can match it and their sizes."""
        if p[0] not in ("iri", "link", "var"):
            return "path closure", sum(t.df.count() for t in self.tables)
        met = [t for t in self.tables if self._scan(t, s, [(("iri", p[1]) if p[0] == "link" else p, o)]) is not None]
        return "scan of " + ", ".join(t.name for t in met) if met else "nothing", sum(t.df.count() for t in met)

    def nothing(self, names):
        df = self.spark.range(0).select(*[F.lit(None).cast("string").alias(columns(v, WHOLE)[0]) for v in names])
        return Plan(df, dict.fromkeys(names, WHOLE), frozenset(names))

    def star(self, subject, patterns, graph=None):
        """Solutions of patterns [(p, o)] on one subject; p is an IRI term or a variable."""
        names = list(dict.fromkeys(t[1] for t in (subject, *[x for po in patterns for x in po]) if t[0] == "var"))
        if graph is not None:
            return self.nothing(names)
        found = [p for t in self.tables if (p := self._scan(t, subject, patterns)) is not None]
        return union(found) if found else self.nothing(names)

    def _scan(self, table, subject, patterns):
        vals, conds, df = {}, [], table.df
        own = Val(table.subject, *[F.col(k) for k in table.keys])

        def bind(t, val):
            """False when the position can't match."""
            if t[0] == "var":
                if t[1] in vals:
                    a, b = vals[t[1]], val
                    if a.rep == b.rep:
                        conds.extend(x == y for x, y in zip(a.cols, b.cols))
                    elif a.rep.kind != b.rep.kind and "term" not in (a.rep.kind, b.rep.kind):
                        return False
                    else:
                        conds.append(convert(a, ANY).col == convert(b, ANY).col)
                else:
                    vals[t[1]] = val
                return True
            if t[0] == "iri" and val.rep.kind == "iri":
                if val.rep.template is None:
                    conds.append(val.col == t[1])
                    return True
                keys = template_keys(val.rep.template, t[1])
                if keys is None:
                    return False
                kinds = dict(table.df.dtypes)
                for c, k in zip(val.cols, keys):
                    conds.append(c == F.lit(k).cast(kinds.get(_name(c), "string")))
                return True
            if t[0] == "lit" and val.rep.kind == "lit":
                if t[2] != val.rep.dt or (t[3] or None) != (val.rep.lang or None):
                    return False
                conds.append(val.col == Val.const(t).col)
                return True
            if val.rep.kind == "term":
                conds.append(val.col == Val.const(t).term())
                return True
            return False

        if not bind(subject, own):
            return None
        for n, (p, o) in enumerate(patterns):
            if p[0] == "iri":
                if p[1] == TYPE and _is_const(o):
                    if o[1] not in table.classes:
                        return None
                elif p[1] == TYPE:
                    if not table.classes:
                        return None
                    df = df.withColumn(f"q_class{n}", F.explode(F.array(*[F.lit(c) for c in table.classes])))
                    if not bind(o, Val(WHOLE, F.col(f"q_class{n}"))):
                        return None
                elif p[1] in table.props:
                    rep, cols = table.props[p[1]]
                    conds.extend(F.col(c).isNotNull() for c in cols)
                    if not bind(o, Val(rep, *[F.col(c) for c in cols])):
                        return None
                else:
                    return None
            else:
                pairs = [F.struct(F.lit(i).alias("p"), Val(rep, *[F.col(c) for c in cols]).term().alias("o")) for i, (rep, cols) in table.props.items()]
                pairs += [F.struct(F.lit(TYPE).alias("p"), Val(WHOLE, F.lit(c)).term().alias("o")) for c in table.classes]
                df = df.withColumn(f"q_pair{n}", F.explode(F.array(*pairs))).where(F.col(f"q_pair{n}.o").isNotNull())
                if not bind(p, Val(WHOLE, F.col(f"q_pair{n}.p"))) or not bind(o, Val(ANY, F.col(f"q_pair{n}.o"))):
                    return None
        for c in conds:
            df = df.where(c)
        out = {c: col for v, val in vals.items() for c, col in zip(columns(v, val.rep), val.cols)}
        df = df.select(*[col.alias(c) for c, col in out.items()]) if out else df.select(F.lit(1).alias("q_one"))
        return Plan(df, {v: val.rep for v, val in vals.items()}, frozenset(vals))

    def weight(self, pattern):
        """Rough cost rank of a pattern for join ordering: bound ends are cheaper."""
        s, p, o = pattern
        return (s[0] == "var") + (o[0] == "var") + 2 * (p[0] == "var")


def _name(col):
    return col._jc.toString().strip("`") if hasattr(col, "_jc") else str(col)

