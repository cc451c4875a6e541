"""Quad streams: N-Quads text arriving in a folder keeps a materialised store current through foreachBatch."""

from pyspark.sql import functions as F

from ..functions.terms import term_id
from ..operators.datalog import insert_quads
from ..sources.rdf import DEFAULT, LINE, parse_term


def quad_stream(spark, folder):
    """Streaming rows (s, p, o, g) of N-Triples texts from new files in a folder."""
    lines = spark.readStream.format("text").load(folder).where(~F.col("value").rlike(r"^\s*(#.*)?$"))
    parts = lines.select(*[F.regexp_extract("value", LINE, i).alias(n) for i, n in enumerate("spog", 1)]).where("s <> ''")
    return parts.withColumn("g", F.when(F.col("g") == "", f"<{DEFAULT}>").otherwise(F.col("g")))


def maintain(store, stream, checkpoint):
    """Start a query that inserts every batch into the store and extends its rules' closure incrementally."""

    def batch(df, _):
        terms = df.select(*[parse_term(F.col(c)).alias(c) for c in "spog"])
        ids = terms.select(*[term_id(F.col(c)).alias(c) for c in "gspo"])
        new = terms.select(F.explode(F.array("s", "p", "o", "g")).alias("term")).distinct().select(term_id(F.col("term")).alias("id"), "term")
        store.source = insert_quads(store.source, store.rules, ids, new)
        store.generation += 1

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).start()
