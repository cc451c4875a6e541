"""The registered queries of the training-data operators and the SQL of those that SQL can express."""

from pyspark.sql import functions as F

from . import mixing, oracles
from .cross_parse import whole_parse_scores
from .cross_polytope import similar_vectors
from .decontam import contamination
from .html_main import main_texts
from .near_dup import near_duplicates
from .passages import repeated_passages
from .suffix_dedup import without_repeats
from .toxicity import held_out, toxicity
from .url_rules import judge


def _read(spark, sf_dir, table):
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_chained_passages(spark, sf_dir):
    return repeated_passages(spark, _read(spark, sf_dir, "documents"))


def op2_url_rules(spark, sf_dir):
    return judge(spark, _read(spark, sf_dir, "pages"), _read(spark, sf_dir, "labels"))


def op3_ziv_merhav(spark, sf_dir):
    good = _read(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return whole_parse_scores(spark, _read(spark, sf_dir, "documents"), good)


def op4_pfair_mix(spark, sf_dir):
    return mixing.mix(spark, _read(spark, sf_dir, "documents"))


def op5_crf_toxicity(spark, sf_dir):
    scored = toxicity(spark, _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))
    return scored.select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def op6_induced_suffix(spark, sf_dir):
    return without_repeats(spark, _read(spark, sf_dir, "documents")).drop("kept")


def op7_tag_path_text(spark, sf_dir):
    return main_texts(spark, _read(spark, sf_dir, "pages"))


def op8_simhash_decontam(spark, sf_dir):
    return contamination(spark, _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op9_minhash_near_dup(spark, sf_dir):
    return near_duplicates(spark, _read(spark, sf_dir, "documents"), n=4, percent=80)


def op10_cross_polytope(spark, sf_dir):
    return similar_vectors(spark, _read(spark, sf_dir, "embeddings"))


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries():
    return {"pipeline": pipeline} | {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


def oracle_sql():
    return {"op4_pfair_mix": mixing.ORACLE} | oracles.SQL
