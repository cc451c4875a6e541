"""The front door: a graph over tables or RDF data, with queries, rules, shapes and updates."""

from .sources.mapped import MappedSource, map_table
from .sparql.compile import Compiler
from .sparql.parser import parse_query

BASE = "http://ex/"

TABLES = {
    "region": (["r_regionkey"], "Region", {}),
    "nation": (["n_nationkey"], "Nation", {"n_region": ("region/{}", ["n_regionkey"])}),
    "customer": (["c_custkey"], "Customer", {"c_nation": ("nation/{}", ["c_nationkey"])}),
    "supplier": (["s_suppkey"], "Supplier", {"s_nation": ("nation/{}", ["s_nationkey"])}),
    "part": (["p_partkey"], "Part", {}),
    "orders": (["o_orderkey"], "Order", {"o_customer": ("customer/{}", ["o_custkey"])}),
    "lineitem": (None, "LineItem", {"l_order": ("orders/{}", ["l_orderkey"]), "l_part": ("part/{}", ["l_partkey"]), "l_supplier": ("supplier/{}", ["l_suppkey"])}),
    "events": (["event_id"], "Event", {"user": ("user/{}", ["user_id"])}),
    "documents": (["doc_id"], "Document", {}),
    "labels": (["doc_id"], "Label", {"label_of": ("documents/{}", ["doc_id"])}),
    "conversations": (["conv_id", "turn"], "Turn", {}),
}


def tables_source(spark, sf_dir, names=None):
    """The driver tables as virtual RDF: subject <http://ex/{table}/{key}>, property <http://ex/{column}>."""
    return MappedSource(spark, [map_table(spark.read.parquet(f"{sf_dir}/{t}.parquet"), BASE, t, *TABLES[t]) for t in names or TABLES])


class Engine:
    """Queries over one source with fixed prefixes."""

    def __init__(self, source, prefixes=None, base=None):
        self.source, self.base = source, base
        self.prefixes = {"": BASE, "rdf": "http://www.w3.org/1999/02/22-rdf-syntax-ns#", "rdfs": "http://www.w3.org/2000/01/rdf-schema#", "xsd": "http://www.w3.org/2001/XMLSchema#", "owl": "http://www.w3.org/2002/07/owl#"} | (prefixes or {})

    def sparql(self, text, output="values", reorder=True):
        """DataFrame of a query's results."""
        return Compiler(self.source, self.base, reorder).run(parse_query(text, self.prefixes, self.base), output)

    def explain(self, text):
        """The parsed algebra and Spark's formatted plan as one text."""
        q = parse_query(text, self.prefixes, self.base)
        df = Compiler(self.source, self.base).run(q)
        plan = df._jdf.queryExecution().explainString(self.source.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        return f"{algebra(q)}\n{plan}"

    def explain_patterns(self, text):
        """How each triple pattern is read: rows (pattern, access, estimate); estimate is the most rows it can give."""
        q = parse_query(text, self.prefixes, self.base)
        rows = [(pattern_text(t), *self.source.access(*t)) for t in patterns(q)]
        return self.source.spark.createDataFrame(rows, "pattern string, access string, estimate long")

    def sparql_with_timeout(self, text, seconds):
        """Rows of a query, cancelled with its jobs after so many seconds."""
        import threading

        sc = self.source.spark.sparkContext
        tag = f"quadrille-{id(text)}-{seconds}"
        sc.addJobTag(tag)
        timer = threading.Timer(seconds, sc.cancelJobsWithTag, [tag])
        timer.start()
        try:
            return self.sparql(text).collect()
        finally:
            timer.cancel()
            sc.removeJobTag(tag)


def patterns(x):
    """The triple patterns of a parsed query, in order."""
    if isinstance(x, dict):
        return [t for v in x.values() for t in patterns(v)]
    if isinstance(x, tuple) and x and x[0] == "triples":
        return list(x[1])
    if isinstance(x, (list, tuple)):
        return [t for v in x for t in patterns(v)]
    return []


def pattern_text(t):
    word = lambda x: f"?{x[1]}" if x[0] == "var" else f"<{x[1]}>" if x[0] in ("iri", "link") else f'"{x[1]}"' if x[0] == "lit" else f"({x[0]} ...)"
    return " ".join(word(x) for x in t)


def algebra(q, depth=0):
    """Indented text of a parsed query."""
    pad = "  " * depth
    if isinstance(q, dict):
        return "\n".join(f"{pad}{k}:\n{algebra(v, depth + 1)}" if isinstance(v, (dict, list)) and v else f"{pad}{k}: {v}" for k, v in q.items())
    if isinstance(q, list):
        return "\n".join(algebra(x, depth) for x in q)
    if isinstance(q, tuple) and any(isinstance(x, (list, dict)) for x in q):
        return "\n".join([f"{pad}{q[0]}", *(algebra(x, depth + 1) for x in q[1:])])
    return f"{pad}{q}"
