"""Shared storage for cut lineages: the folder in spark.checkpoint.dir."""

import gc
import tempfile
import uuid

from pyspark.sql import functions as F


def shared_dir(spark):
    """The cluster's checkpoint folder; a temporary one only where the setting is absent on one machine, as in tests."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        at = getattr(spark.sparkContext, "_quadrille_dir", None)
        if not at:
            at = "file://" + tempfile.mkdtemp(prefix="quadrille-")
            spark.sparkContext._quadrille_dir = at
    return at


def stored(spark, df, name):
    """df written as Parquet into the shared folder and read back: a restart point that outlives lost executors."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_stored(spark, df):
    """Remove a table made by stored() once nothing reads it."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    roots = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
    for root in roots:
        p = jvm.org.apache.hadoop.fs.Path(root)
        p.getFileSystem(conf).delete(p, True)


def settle(spark):
    """Let Spark's cleaner drop shuffle files that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def beside(spark, df, name, rows=200_000):
    """A table of numbers to join to a much larger one: stored, and broadcast if it has no more than `rows` rows."""
    df = stored(spark, df, name)
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df.hint("merge")


def one_row_each(spark, docs):
    """docs(doc_id, text) with one row per doc_id: of several texts the one with the smallest hash."""
    if not docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("c")).where("c > 1").limit(1).count():
        return docs
    return stored(spark, docs.groupBy("doc_id").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")), "unique")
