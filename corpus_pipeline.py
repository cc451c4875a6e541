"""The corpus pipeline: five stages over documents, each a training-data operator whose decisions take effect.

Defined cases of all stages: null and empty texts are kept unless they repeat (an empty text repeats nothing); rows without
doc_id are documents named by their texts, so they are judged like others and their copies go; rows that share a
doc_id are one document: it goes as a whole when any of its texts is rejected, and one row of it passes the second stage;
extra columns pass through; empty tables give empty results.  The last stage returns doc_id, source, text, lang, n_chars, slot, position.
"""

from functools import wraps

from pyspark.sql import functions as F

from quadrille.llm import mixing
from quadrille.llm._store import stored
from quadrille.llm.decontam import contamination
from quadrille.llm.near_dup import near_duplicates
from quadrille.llm.passages import repeated_passages, without_passages
from quadrille.llm.toxicity import toxicity


def named(stage):
    """The stage on documents of which each has a doc_id: rows without one get a negative name from their text, and lose it after."""

    @wraps(stage)
    def run(spark, docs, sf_dir):
        columns, mark = docs.columns, "unnamed"
        while mark in columns:
            mark += "_"
        kind = docs.schema["doc_id"].dataType
        name = F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).bitwiseOR(F.lit(-(1 << 63)))
        full = docs.withColumn(mark, F.col("doc_id").isNull()).withColumn("doc_id", F.coalesce(F.col("doc_id").cast("long"), name))
        return stage(spark, full, sf_dir).withColumn("doc_id", F.when(~F.col(mark), F.col("doc_id")).cast(kind)).select(*columns)

    return run


@named
def drop_toxic(spark, docs, sf_dir):
    """Documents whose toxicity score is 0.5 or more go."""
    scored = toxicity(spark, docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).where("score >= 0.5").select("doc_id").distinct()
    return docs.join(scored, "doc_id", "left_anti").select(*docs.columns)


@named
def drop_near_duplicates(spark, docs, sf_dir):
    """One document of each class of near duplicates stays: five-word shingles, similarity 0.8 or more."""
    gone = near_duplicates(spark, docs, n=5, percent=80).where("not kept").select("doc_id")
    kept = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    several = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("doc_id")
    if not several.limit(1).count():
        return kept
    one = kept.join(several, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text"), *docs.columns)).alias("row"))
    return kept.join(several, "doc_id", "left_anti").select(*docs.columns).unionByName(one.select(*[F.col("row")[c].alias(c) for c in docs.columns]))


@named
def cut_repeats(spark, docs, sf_dir):
    """Passages of 50 words or more that an earlier document holds are cut from the later one."""
    return without_passages(spark, docs, repeated_passages(spark, docs))


@named
def drop_contaminated(spark, docs, sf_dir):
    """Documents that hold a benchmark item go."""
    hit = contamination(spark, docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select("doc_id").distinct()
    return docs.join(hit, "doc_id", "left_anti").select(*docs.columns)


def mix_sources(spark, docs, sf_dir):
    """Every document's slot and place in the mixture of sources."""
    return mixing.mix(spark, docs, keep=("text", "lang", "n_chars"))


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash_near_dup", drop_near_duplicates),
    ("substring_dedup", cut_repeats),
    ("benchmark_decontamination", drop_contaminated),
    ("pfair_mix", mix_sources),
]

#: SQL can't express the stages of learnt scores, signatures and chains; tests hold them against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over documents, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(spark, docs, name)
    return docs
