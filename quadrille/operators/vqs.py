"""Visual-query index: navigation graph, counts, configuration queries, index tables and their search."""

from dataclasses import dataclass, field

from pyspark.sql import functions as F

from ..functions.names import RDFS, TYPE
from ..sparql.compile import Compiler
from ..sparql.parser import parse_query


@dataclass
class NavGraph:
    """Classes as vertices, properties as edges (source class, property, target class or datatype)."""

    edges: set = field(default_factory=set)

    @staticmethod
    def from_source(source, most=100_000):
        """Edges from rdfs:domain and rdfs:range: the ontology and not the data, so more than `most` are refused."""
        q = f"SELECT ?c ?p ?d {{ ?p <{RDFS}domain> ?c ; <{RDFS}range> ?d }} LIMIT {most + 1}"
        rows = Compiler(source).run(parse_query(q)).collect()
        if len(rows) > most:
            raise ValueError("the ontology has too many edges for the driver")
        return NavGraph({(r.c, r.p, r.d) for r in rows})

    def outgoing(self, cls):
        return sorted((p, d) for c, p, d in self.edges if c == cls)


def class_counts(source):
    """Instances per class."""
    return Compiler(source).run(parse_query(f"SELECT ?class (COUNT(DISTINCT ?s) AS ?n) {{ ?s <{TYPE}> ?class }} GROUP BY ?class"))


def edge_counts(source):
    """Per (source class, property, target class): triples, subjects and objects."""
    q = f"SELECT ?c ?p ?d (COUNT(*) AS ?triples) (COUNT(DISTINCT ?s) AS ?subjects) (COUNT(DISTINCT ?o) AS ?objects) {{ ?s <{TYPE}> ?c ; ?p ?o . ?o <{TYPE}> ?d }} GROUP BY ?c ?p ?d"
    return Compiler(source).run(parse_query(q))


@dataclass(frozen=True)
class Config:
    """A tree query: root class and children (property, Config); leaves may have class None."""

    cls: str | None
    children: tuple = ()

    def sparql(self):
        """Query with every edge optional."""
        names, parts = ["v0"], []

        def walk(node, var):
            body = [f"?{var} <{TYPE}> <{node.cls}> ."] if node.cls else []
            for p, child in node.children:
                v = f"v{len(names)}"
                names.append(v)
                inner = walk(child, v)
                body.append(f"OPTIONAL {{ ?{var} <{p}> ?{v} . {' '.join(inner)} }}")
            return body

        parts = walk(self, "v0")
        return f"SELECT {' '.join('?' + n for n in names)} WHERE {{ {' '.join(parts)} }}"

    def size(self):
        return 1 + sum(c.size() for _, c in self.children)

    def prefixes(self):
        """All trees that keep the root and drop leaves."""
        out = [Config(self.cls)]
        for i, (p, c) in enumerate(self.children):
            out += [Config(self.cls, self.children[:i] + ((p, s),)) for s in c.prefixes()]
        return out


def index_table(source, config):
    """Distinct rows of a configuration query; what the index stores."""
    return Compiler(source).run(parse_query(config.sparql())).distinct()


def lookup(table, column, **bound):
    """Values of a column among index rows that match the bound columns."""
    for c, v in bound.items():
        table = table.where(F.col(c) == v)
    return table.select(column).where(F.col(column).isNotNull()).distinct()


def estimated_answers(counts, edges, config):
    """Estimated rows of a configuration query from class and edge counts (dictionaries)."""
    total = float(counts.get(config.cls, 0))
    for p, c in config.children:
        total *= max(1.0, branching(counts, edges, config.cls, p, c.cls) * max(1.0, estimated_answers(counts, edges, c) / max(1.0, counts.get(c.cls, 1))))
    return total


def branching(counts, edges, cls, prop, target):
    """Average targets per instance of a class over a property."""
    return edges.get((cls, prop, target), 0) / max(1, counts.get(cls, 1))


def query_weight(log, config):
    """Share of logged queries (Config: frequency) that the configuration covers."""
    total = sum(log.values()) or 1
    inside = set(config.prefixes()) | {config}
    return sum(n for q, n in log.items() if q in inside) / total


def greedy_search(candidates, log, counts, edges, budget):
    """Configurations by weight gained per estimated row until the budget of rows is used."""
    chosen, used, left = [], 0.0, dict(log)
    pool = list(candidates)
    while pool:
        cost = lambda c: max(1.0, estimated_answers(counts, edges, c))
        best = max(pool, key=lambda c: (query_weight(left, c) / cost(c), -c.size()))
        pool.remove(best)
        if used + cost(best) > budget or query_weight(left, best) == 0:
            continue
        chosen.append(best)
        used += cost(best)
        gone = set(best.prefixes()) | {best}
        left = {q: n for q, n in left.items() if q not in gone}
    return chosen


def random_search(candidates, log, counts, edges, budget, tries=100, seed=0):
    """Best of random orders under the budget."""
    import random

    rng, best, best_weight = random.Random(seed), [], -1.0
    for _ in range(tries):
        order = list(candidates)
        rng.shuffle(order)
        chosen, used = [], 0.0
        for c in order:
            n = max(1.0, estimated_answers(counts, edges, c))
            if used + n <= budget:
                chosen.append(c)
                used += n
        w = sum(query_weight(log, c) for c in chosen)
        if w > best_weight:
            best, best_weight = chosen, w
    return best
