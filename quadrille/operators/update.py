"""SPARQL updates, graph store operations, transactions and a durable change log over immutable quad sources."""

import os
import time
import uuid

from pyspark.sql import functions as F

from ..functions.terms import Val, term_id
from ..plans.store import materialise
from ..sources.quads import MOST_LAYERS, QuadSource, clustered, with_components
from ..sources.rdf import DEFAULT, load, parse_term
from ..sparql.compile import Compiler
from ..sparql.parser import parse_update
from .datalog import KEY, materialise_rules

EMPTY = "s string, p string, o string, g string"


class Store:
    """A current source plus rules to keep materialised; every change makes a new snapshot."""

    def __init__(self, source, rules=(), base=None, prefixes=None, allow_load=None, log=None):
        self.spark, self.source, self.rules, self.base, self.prefixes = source.spark, source, list(rules), base, prefixes or {}
        self.allow_load, self.log, self.generation, self.layers = allow_load, log, 0, 0

    # updates
    def update(self, text):
        """Apply all operations of an update text, or none if one fails."""
        before = self.source
        try:
            for op in parse_update(text, self.prefixes, self.base):
                self.apply(op)
        except Exception:
            self.source = before
            raise
        if self.rules:
            base = QuadSource(self.spark, self.source.quads.where("not derived"), self.source.terms)
            self.source = materialise_rules(base, self.rules)
        self.generation += 1
        return self

    def texts(self, template, where, using):
        """Rows (s, p, o, g) of N-Triples texts of a template over a pattern."""
        if not template:
            return self.spark.createDataFrame([], EMPTY)
        compiler = Compiler(self.source, self.base)
        plan = compiler.group(where or [], ("set", using) if using else None)
        rows = compiler.construct(plan, template)
        return rows.withColumn("g", F.when(F.col("g") == "", f"<{DEFAULT}>").otherwise(F.col("g")))

    def as_ids(self, texts):
        terms = texts.select(*[parse_term(F.col(c)).alias(c) for c in "spog"])
        ids = terms.select(*[term_id(F.col(c)).alias(c) for c in KEY])
        new = terms.select(F.explode(F.array("s", "p", "o", "g")).alias("term")).distinct()
        if texts.where("s like '<<%' or o like '<<%'").limit(1).count():
            new = with_components(new)
        new = new.select(term_id(F.col("term")).alias("id"), "term")
        return ids, new

    def change(self, gone, new):
        """Delete then insert rows of texts; a quad in both stays."""
        gone, new = materialise(gone, "gone"), materialise(new, "new")
        gone_ids, _ = self.as_ids(gone)
        new_ids, terms = self.as_ids(new)
        self.overlay(gone_ids, new_ids.withColumn("derived", F.lit(False)), terms)
        if self.log:
            self.log.append(gone, new)

    def overlay(self, gone, new, terms=None):
        """A snapshot of the present quads without gone and with new ones: two small tables on top, merged when it is read."""
        new = materialise(new.select(*KEY, "derived").distinct(), "added")
        over = new.select(*KEY) if gone is None else materialise(gone.select(*KEY).unionByName(new.select(*KEY)).distinct(), "over")
        self.settle(self.source.quads.join(over, KEY, "left_anti").unionByName(new), terms)

    def settle(self, quads, terms=None):
        """Make the quads current; every few layers they are stored as one clustered table, so reads stay short."""
        self.layers += 1
        if self.layers >= MOST_LAYERS:
            quads, self.layers = materialise(clustered(quads), "quads"), 0
        self.source = self.source.with_quads(quads, terms)

    def apply(self, op):
        kind = op[0]
        if kind == "modify":
            _, gone, new, where, using, _ = op
            self.change(self.texts(gone, where, using), self.texts(new, where, using))
        elif kind in ("clear", "drop"):
            self.keep(~self.in_graph(op[1]))
        elif kind == "create":
            pass
        elif kind in ("copy", "move", "add"):
            source, target = op[1], op[2]
            moved = self.source.quads.where(self.in_graph(source)).withColumn("g", self.graph_id(target))
            q = self.source.quads if kind == "add" else self.source.quads.where(~self.in_graph(target))
            if kind == "move":
                q = q.where(~self.in_graph(source))
            name = self.spark.range(1).select(Val.const(("iri", self.graph_iri(target))).term().alias("term")).select(term_id(F.col("term")).alias("id"), "term")
            if kind == "add":
                moved = moved.join(q.where(self.in_graph(target)).select(*KEY), KEY, "left_anti")
            self.settle(q.unionByName(moved.select(*q.columns)), name)
        elif kind == "load":
            self.load(op[1], op[2], op[3])

    @staticmethod
    def graph_iri(ref):
        return DEFAULT if ref == "DEFAULT" else ref[1]

    def graph_id(self, ref):
        return Val.const(("iri", self.graph_iri(ref))).id()

    def in_graph(self, ref):
        default = F.col("g") == Val.const(("iri", DEFAULT)).id()
        if ref == "ALL":
            return F.lit(True)
        if ref == "NAMED":
            return ~default
        return F.col("g") == self.graph_id(ref)

    def keep(self, cond):
        self.settle(self.source.quads.where(cond))

    def load(self, iri, into, silent):
        """LOAD of local files below the allowed folder; nothing is fetched."""
        path = iri[7:] if iri.startswith("file://") else None
        root = os.path.realpath(self.allow_load) if self.allow_load else None
        if not path or not root or not os.path.realpath(path).startswith(root + os.sep):
            if silent:
                return
            raise PermissionError(f"not allowed to load {iri}")
        quads = load(self.spark, path)
        if into:
            quads = quads.withColumn("g", Val.const(("iri", into)).term())
        self.merge(quads)

    def merge(self, quads):
        """Add quads of term structs."""
        other = QuadSource.from_quads(self.spark, quads, check=False)
        self.overlay(None, other.quads, other.terms)

    # graph store
    def get_graph(self, graph=DEFAULT):
        return self.source.as_terms().where(F.col("g.lex") == graph)

    def put_graph(self, quads, graph=DEFAULT):
        self.keep(F.col("g") != Val.const(("iri", graph)).id())
        self.post_graph(quads, graph)

    def post_graph(self, quads, graph=DEFAULT):
        self.merge(quads.select("s", "p", "o").withColumn("g", Val.const(("iri", graph)).term()))
        self.generation += 1

    def delete_graph(self, graph=DEFAULT):
        self.keep(F.col("g") != Val.const(("iri", graph)).id())
        self.generation += 1

    def has_graph(self, graph):
        return not self.source.quads.where(F.col("g") == Val.const(("iri", graph)).id()).isEmpty()

    # transactions
    def begin(self):
        return Transaction(self)


class Conflict(RuntimeError):
    """The store changed after the transaction began."""


class Transaction:
    """Updates on a private snapshot; commit succeeds only if the store didn't change meanwhile."""

    def __init__(self, store, timeout=3600):
        self.store, self.generation, self.until = store, store.generation, time.time() + timeout
        self.work = Store(store.source, store.rules, store.base, store.prefixes, store.allow_load)

    def update(self, text):
        self.work.update(text)
        return self

    def commit(self):
        if self.store.generation != self.generation or time.time() > self.until:
            raise Conflict("the store changed or the transaction expired")
        self.store.source, self.store.generation = self.work.source, self.store.generation + 1

    def rollback(self):
        self.work = None


class ChangeLog:
    """Append-only Parquet log of deleted and inserted statements; compaction folds it into one batch."""

    def __init__(self, spark, path):
        self.spark, self.path, self.n = spark, path, 0

    def append(self, gone, new):
        """One batch: rows (seq, op, s, p, o, g) of texts."""
        seq = time.time_ns()
        rows = gone.withColumn("op", F.lit("-")).unionByName(new.withColumn("op", F.lit("+"))).withColumn("seq", F.lit(seq))
        rows.write.mode("append").parquet(self.path)

    def final(self):
        """The statements that the log leaves: each one's last change, insertions winning within a batch."""
        log = self.spark.read.parquet(self.path)
        last = log.groupBy("s", "p", "o", "g").agg(F.max(F.struct("seq", (F.col("op") == "+").alias("add"))).alias("l"))
        return last.where("l.add").select("s", "p", "o", "g")

    def replay(self):
        """A source of the logged statements."""
        quads = self.final().select(*[parse_term(F.col(c)).alias(c) for c in "spog"])
        return QuadSource.from_quads(self.spark, quads)

    def compact(self):
        """Write the final statements as one batch to a new folder and use that from now on."""
        to = f"{self.path}-{uuid.uuid4().hex[:8]}"
        self.final().withColumn("op", F.lit("+")).withColumn("seq", F.lit(time.time_ns())).write.parquet(to)
        self.path = to
        return to
