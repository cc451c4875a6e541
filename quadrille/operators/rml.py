"""RML: mapping documents over CSV, JSON, XML, SQL and Parquet sources to quads, as DataFrame projections and joins."""

import os
import re

from pyspark.sql import functions as F

from ..functions.names import RDF, TYPE
from ..functions.terms import BNODE, IRI, LIT, STRING, Val, encode, term
from ..sources.rdf import DEFAULT, parse_document
from .owl import Ontology

SPACES = ("http://www.wiwiss.fu-berlin.de/suhl/bizer/D2RQ/0.1#", "http://w3id.org/rml/", "http://www.w3.org/ns/r2rml#", "http://semweb.mmlab.be/ns/rml#", "http://semweb.mmlab.be/ns/fnml#", "http://w3id.org/fnml/")
FUNCTIONS = {"toUpperCase": F.upper, "toLowerCase": F.lower, "trim": F.trim}


class Mapping(Ontology):
    """A mapping graph; names match in any of the mapping vocabularies."""

    @staticmethod
    def from_text(text, base=None):
        return Mapping([q[:3] for q in parse_document(text, "turtle", base)])

    def all(self, node, name):
        return [o for ns in SPACES for o in self.get(node, ns + name)]

    def first(self, node, name):
        return next(iter(self.all(node, name)), None)

    def maps(self):
        return [s for s in self.po if self.first(s, "logicalSource") or self.first(s, "logicalTable")]


def confine(root, path):
    """The path below root; raises when it leads outside."""
    full = os.path.realpath(os.path.join(root, path))
    if root and full != os.path.realpath(root) and not full.startswith(os.path.realpath(root) + os.sep):
        raise PermissionError(f"{path} is outside the data folder")
    return full


def column(ref):
    """Column of a reference such as name, a.b or @id."""
    ref = ref.removeprefix("$.").replace("@", "_")
    return F.col(".".join(f"`{p}`" for p in ref.split("."))) if ref else F.col("value")


class Mapper:
    """Runs a mapping; tables holds DataFrames for SQL table names, root is the folder of file sources."""

    def __init__(self, spark, mapping, root=".", tables=None):
        self.spark, self.m, self.root, self.tables = spark, Mapping.from_text(mapping) if isinstance(mapping, str) else mapping, root, tables or {}

    def source(self, node):
        """DataFrame of a triples map's logical source."""
        m = self.m
        ls = m.first(node, "logicalSource") or m.first(node, "logicalTable")
        kind = (m.first(ls, "referenceFormulation") or ("iri", "SQL2008"))[1].rsplit("/", 1)[-1].rsplit("#", 1)[-1]
        src = m.first(ls, "source")
        if src and src[0] != "lit" and (dsn := m.first(src, "jdbcDSN")):
            return self.database(src, dsn[1], m.first(ls, "tableName") or m.first(ls, "query") or m.first(ls, "sqlQuery"), bool(m.first(ls, "tableName")))
        if name := m.first(ls, "tableName"):
            return self.tables[name[1]] if name[1] in self.tables else self.spark.table(name[1])
        if query := m.first(ls, "query") or m.first(ls, "sqlQuery"):
            for n, df in self.tables.items():
                df.createOrReplaceTempView(n)
            return self.spark.sql(query[1])
        path = src[1] if src[0] == "lit" else (m.first(src, "path") or m.first(src, "url") or ("lit", ""))[1]
        if path in self.tables:
            return self.tables[path]
        path = confine(self.root, path)
        iterator = (m.first(ls, "iterator") or ("lit", ""))[1]
        if kind.startswith("CSV"):
            return self.spark.read.csv(path, header=True, sep=(m.first(ls, "delimiter") or ("lit", ","))[1])
        if kind.startswith("JSON"):
            lines = path.endswith((".jsonl", ".ndjson"))
            df = self.spark.read.option("primitivesAsString", True).json(path, multiLine=not lines)
            for step in [s for s in iterator.removeprefix("$").split(".") if s and s != "[*]"]:
                name = step.split("[")[0]
                df = df.select(F.explode(F.col(f"`{name}`")).alias("q_item")) if "[" in step else df.select(F.col(f"`{name}`").alias("q_item"))
                df = df.select("q_item.*") if dict(df.dtypes)["q_item"].startswith("struct") else df.withColumnRenamed("q_item", "value")
            return df
        if kind.startswith("XPath") or kind.startswith("XML"):
            return self.spark.read.format("xml").option("rowTag", iterator.rstrip("/").rsplit("/", 1)[-1]).option("inferSchema", False).load(path)
        return self.spark.read.parquet(path)

    def database(self, src, dsn, what, table):
        """A table or query of a database: filters and columns are pushed down to it; with a partition column it is read in parts."""
        m, read = self.m, self.spark.read.format("jdbc").option("url", dsn).option("dbtable" if table else "query", what[1])
        for name, option in (("jdbcDriver", "driver"), ("username", "user"), ("password", "password")):
            if v := m.first(src, name):
                read = read.option(option, v[1])
        return read.load()

    def text(self, node, iri=False):
        """Text column of a term map's value: template, reference, constant or function."""
        m = self.m
        if t := m.first(node, "template"):
            parts = re.split(r"\{([^{}]*)\}", t[1])
            return F.concat(*[F.lit(x) if i % 2 == 0 else (encode(column(x)) if iri else column(x).cast("string")) for i, x in enumerate(parts)])
        if r := m.first(node, "reference") or m.first(node, "column"):
            return column(r[1]).cast("string")
        if f := m.first(node, "functionExecution") or m.first(node, "functionValue"):
            name = (m.first(f, "function") or m.first(f, "functionName"))[1]
            arg = next(self.text(m.first(i, "inputValueMap") or i) if not m.first(i, "inputValue") else F.lit(m.first(i, "inputValue")[1]) for i in m.all(f, "input"))
            return FUNCTIONS[re.split(r"[#/]", name)[-1]](arg)
        return None

    def term(self, node, default):
        """Term struct column of a term map; default is IRI or LIT for references."""
        m = self.m
        if (c := m.first(node, "constant")) is not None:
            return Val.const(c).term()
        if node[0] in ("iri", "lit") and node not in m.po:
            return Val.const(node).term()
        kind = (m.first(node, "termType") or ("iri", ""))[1].rsplit("#", 1)[-1].rsplit("/", 1)[-1]
        lang, dt = m.first(node, "language"), m.first(node, "datatype")
        if kind == "Literal" or (not kind and (lang or dt)):
            kind = "Literal"
        elif not kind:
            kind = "IRI" if default == IRI or m.first(node, "template") else "Literal"
        x = self.text(node, iri=kind == "IRI")
        if kind == "IRI":
            ok = x.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:")
            return F.when(ok, term(IRI, x))
        if kind == "BlankNode":
            return F.when(x.isNotNull(), term(BNODE, x))
        tag = RDF + "langString" if lang else dt[1] if dt else STRING
        return F.when(x.isNotNull(), term(LIT, x, F.lit(tag), F.lit(lang[1].lower() if lang else "")))

    def graphs(self, *nodes):
        m = self.m
        maps = [g for n in nodes for g in m.all(n, "graphMap") + m.all(n, "graph")]
        return [self.term(g, IRI) for g in maps] or [Val.const(("iri", DEFAULT)).term()]

    def subject(self, tm):
        s = self.m.first(tm, "subjectMap")
        return (s, self.term(s, IRI)) if s else (None, Val.const(self.m.first(tm, "subject")).term())

    def quads(self):
        """Quads (s, p, o, g) of all triples maps, distinct; a missing value drops its triple."""
        m, out = self.m, None

        def add(df, s, p, o, graphs):
            nonlocal out
            for g in graphs:
                part = df.select(s.alias("s"), p.alias("p"), o.alias("o"), g.alias("g")).where("s is not null and p is not null and o is not null and g is not null")
                out = part if out is None else out.unionByName(part)

        for tm in m.maps():
            df = self.source(tm)
            s_node, s = self.subject(tm)
            here = [s_node] if s_node else []
            for c in m.all(s_node, "class") if s_node else []:
                add(df, s, Val.const(("iri", TYPE)).term(), Val.const(c).term(), self.graphs(*here))
            for pom in m.all(tm, "predicateObjectMap"):
                preds = [self.term(x, IRI) for x in m.all(pom, "predicateMap") + m.all(pom, "predicate")]
                graphs = self.graphs(pom, *here)
                for o in m.all(pom, "objectMap") + m.all(pom, "object"):
                    if parent := m.first(o, "parentTriplesMap"):
                        joined, obj, subj = self.parent_join(df, s, o, parent)
                        for p in preds:
                            add(joined, subj, p, obj, graphs)
                    else:
                        for p in preds:
                            add(df, s, p, self.term(o, LIT), graphs)
        if out is None:
            from ..sources.rdf import TERM4

            return self.spark.createDataFrame([], TERM4)
        return out.distinct()

    def parent_join(self, df, s, o, parent):
        """Child rows joined with the parent map's subjects; without conditions the same row is meant."""
        m = self.m
        conds = [(m.first(j, "child")[1], m.first(j, "parent")[1]) for j in m.all(o, "joinCondition")]
        _, obj = self.subject(parent)
        if not conds:
            return df, obj, s
        right = self.source(parent).select(obj.alias("q_obj"), *[column(p).cast("string").alias(f"q_p{i}") for i, (_, p) in enumerate(conds)]).distinct()
        left = df.withColumns({f"q_c{i}": column(c).cast("string") for i, (c, _) in enumerate(conds)})
        cond = F.lit(True)
        for i in range(len(conds)):
            cond = (F.col(f"q_c{i}") == F.col(f"q_p{i}")) if i == 0 else cond & (F.col(f"q_c{i}") == F.col(f"q_p{i}"))
        return left.join(right, cond), F.col("q_obj"), s


def map_quads(spark, mapping, root=".", tables=None):
    """Quads of a mapping text."""
    return Mapper(spark, mapping, root, tables).quads()


__all__ = ["Mapper", "Mapping", "confine", "map_quads"]
