"""Corpus preparation: quality filter, exact dedup, near dedup, decontamination, tokenisation.

Each stage takes ``(spark, docs, sf_dir)``, works on every row that its predecessor kept, and returns a DataFrame that is
written as Parquet and read again as the next one's ``docs``.  All but the last return the columns of ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starql.llm.bpe import bpe_encode
from starql.llm.common import bound_batches, materialise, release, written
from starql.llm.decontaminate import decontaminate
from starql.llm.exact_dedup import exact_dedup
from starql.llm.mil_quality import THRESHOLD, score_quality
from starql.llm.mil_quality import fit as fit_quality
from starql.llm.minhash_join import jaccard_join
from starql.llm.queries import tokenizer_file


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores below its threshold go."""
    bound_batches(spark)
    model = fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_quality(docs, model).where(F.col("score") >= THRESHOLD).select(docs.columns)


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the smallest id stays."""
    return exact_dedup(docs).where("kept").select(docs.columns)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies, the row with the smallest id stays."""
    bound_batches(spark)
    return jaccard_join(docs).where("is_first").select(docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage, verbatim or edited, go."""
    bound_batches(spark)
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(docs.columns)


def tokenise_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left."""
    bound_batches(spark)
    done = bpe_encode(docs.select("doc_id", "text"), tokenizer_file())
    return done.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("quality", quality_stage),
    ("exact_dedup", exact_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("tokenise", tokenise_stage),
]

#: No SQL: the classifier, the alignment and the tokenizer have none.  The tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies all stages; what a stage wrote on its way, and its input, are removed once its result is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = written(spark)
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
        own = [p for p in written(spark) if p not in before]
        release(spark, own[:-1])  # the last one is this stage's result
    return docs
