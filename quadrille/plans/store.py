"""Shared storage for intermediate tables of fixpoint loops: the folder in spark.checkpoint.dir."""

import tempfile
import uuid


def shared_dir(spark):
    """The cluster's checkpoint folder; a temporary one only where the setting is absent on one machine, as in tests."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        at = getattr(spark.sparkContext, "_quadrille_engine_dir", None)
        if not at:
            at = "file://" + tempfile.mkdtemp(prefix="quadrille-engine-")
            spark.sparkContext._quadrille_engine_dir = at
    return at


def materialise(df, name="step"):
    """df written to the shared folder and read back, which cuts its lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of a partition where a step sorts or hashes; what a task holds then doesn't grow with the table.
ROWS = 1_000_000


def partitions(rows):
    """Partitions for so many rows; None, Spark's own choice, for a few."""
    return rows // ROWS + 1 if rows > 4 * ROWS else None


def spread(df, rows, *columns):
    """df by the hash of columns, in partitions of about ROWS rows if there are many."""
    n = partitions(rows)
    return df.repartition(n, *columns) if n else df


def discard(*tables):
    """Remove the files of materialised tables that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        for root in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
            path.getFileSystem(conf).delete(path, True)
