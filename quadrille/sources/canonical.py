"""Canonical labels of blank nodes (RDF Dataset Canonicalization 1.0, SHA-256).

A blank node's first-degree hash is that of its sorted quads with itself as _:a and others as _:z.  These hashes are
DataFrame aggregations.  Nodes with a hash of their own are labelled in the order of the hashes; usually that is all of them.
Nodes that share a hash are told apart by paths to their neighbours, for which their connected part of the blank node
graph is taken to the driver: at most `most` quads, more are refused.
"""

import hashlib
from itertools import permutations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.terms import ANY, BNODE, Val
from .rdf import DEFAULT, nt_columns, nquads_lines

ENDS = ["s", "o", "g"]


def first_degree(quads):
    """Rows (node, hash) of the blank nodes of quads (s, p, o, g)."""
    label = lambda c: F.when(F.col(c)["kind"] == BNODE, F.col(c)["lex"])
    q = quads.withColumn("nodes", F.array_distinct(F.filter(F.array(*[label(c) for c in ENDS]), lambda x: x.isNotNull())))
    q = q.withColumn("node", F.explode("nodes"))
    own = lambda c: F.when(F.col(c)["kind"] == BNODE, F.when(F.col(c)["lex"] == F.col("node"), "_:a").otherwise("_:z")).otherwise(Val(ANY, F.col(c)).nt())
    graph = F.when(F.col("g")["lex"] == DEFAULT, F.lit("")).otherwise(F.concat(F.lit(" "), own("g")))
    line = F.concat(own("s"), F.lit(" "), own("p"), F.lit(" "), own("o"), graph, F.lit(" .\n"))
    lines = q.select("node", line.alias("line")).groupBy("node").agg(F.sort_array(F.collect_list("line")).alias("lines"))
    return lines.select("node", F.sha2(F.array_join("lines", "").cast("binary"), 256).alias("hash"))


class Paths:
    """N-degree hashing of the blank nodes of a bounded set of quads (tuples of N-Triples texts; blank nodes as _:label)."""

    def __init__(self, quads, hashes):
        self.hashes, self.of = hashes, {}
        for q in quads:
            for n in {x for x in (q[0], q[2], q[3]) if x.startswith("_:")}:
                self.of.setdefault(n, []).append(q)

    @staticmethod
    def sha(text):
        return hashlib.sha256(text.encode()).hexdigest()

    def related(self, node, q, at, issued, local):
        """Hash of a neighbour at a place of a quad."""
        who = issued.get(node) or local.get(node) or self.hashes[node]
        return self.sha(at + (f"<{q[1][1:-1]}>" if at != "g" else "") + who)

    def paths(self, node, issued, local):
        """(hash, labels) of a node by its paths; labels are the temporary ones given on the way."""
        groups = {}
        for q in self.of.get(node, []):
            for at, x in (("s", q[0]), ("o", q[2]), ("g", q[3])):
                if x.startswith("_:") and x != node:
                    groups.setdefault(self.related(x, q, at, issued, local), []).append(x)
        text = ""
        for h in sorted(groups):
            text += h
            best, chosen = None, None
            for order in permutations(groups[h]):
                mine, path, todo = dict(local), "", []
                for x in order:
                    if x in issued:
                        path += issued[x]
                    else:
                        if x not in mine:
                            mine[x] = f"_:b{len(mine)}"
                            todo.append(x)
                        path += mine[x]
                    if best is not None and len(path) >= len(best) and path > best:
                        break
                else:
                    for x in todo:
                        deeper, mine = self.paths(x, issued, mine)
                        path += mine[x] + f"<{deeper}>"
                    if best is None or path < best:
                        best, chosen = path, mine
            text += best
            local = chosen
        return self.sha(text), local


def canonical_labels(quads, most=100_000):
    """Rows (node, label): canonical names c14n0, c14n1, ... of the blank nodes."""
    spark = quads.sparkSession
    hashes = first_degree(quads).withColumn("same", F.count(F.lit(1)).over(Window.partitionBy("hash")))
    unique = hashes.where("same = 1")
    ordered = unique.repartitionByRange("hash").sortWithinPartitions("hash").select("node", "hash")
    ordered = ordered.select("node", (F.row_number().over(Window.orderBy("hash")) - 1).alias("n"))
    labelled = ordered.select("node", F.concat(F.lit("c14n"), F.col("n")).alias("label"))
    shared = hashes.where("same > 1").select("node", "hash")
    if not shared.limit(1).count():
        return labelled
    flat = nt_columns(quads).withColumn("g", F.when(F.col("g") == f"<{DEFAULT}>", "").otherwise(F.col("g")))
    with_nodes = flat.where("s like '\\_:%' or o like '\\_:%' or g like '\\_:%'").limit(most + 1).collect()
    if len(with_nodes) > most:
        raise ValueError("too many quads with blank nodes that are alike")
    issued = {"_:" + r.node: "_:" + r.label for r in labelled.collect()}
    by, every = {}, {"_:" + r.node: r.hash for r in hashes.collect()}
    for n, h in every.items():
        if n not in issued:
            by.setdefault(h, []).append(n)
    paths = Paths([(r.s, r.p, r.o, r.g) for r in with_nodes], every)
    for h in sorted(by):
        found = []
        for n in by[h]:
            if n not in issued:
                found.append(paths.paths(n, issued, {n: "_:b0"}))
        for _, local in sorted(found, key=lambda x: x[0]):
            for n in local:  # in the order in which they were named
                if n not in issued:
                    issued[n] = f"_:c14n{len(issued)}"
    return spark.createDataFrame([(n[2:], x[2:]) for n, x in issued.items()], "node string, label string")


def canonical_lines(quads, most=100_000):
    """The canonical N-Quads lines, unordered; sorted by code point they are the canonical document."""
    labels = canonical_labels(quads, most)
    for c in ENDS:
        look = labels.select(F.col("node").alias(f"n_{c}"), F.col("label").alias(f"l_{c}"))
        at = F.col(c)
        quads = quads.join(look, (at["kind"] == BNODE) & (at["lex"] == F.col(f"n_{c}")), "left")
        quads = quads.withColumn(c, F.when(F.col(f"l_{c}").isNotNull(), at.withField("lex", F.col(f"l_{c}"))).otherwise(at)).drop(f"n_{c}", f"l_{c}")
    return nquads_lines(quads.select("s", "p", "o", "g")).distinct()


__all__ = ["canonical_labels", "canonical_lines", "first_degree"]
