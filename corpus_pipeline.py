"""The training-data pipeline: five stages over ``documents``, each written as Parquet and read again.

Language ID, near-duplicate removal, benchmark decontamination, mixing to target weights, token-ID output.  Each stage
works on all that its predecessor kept, and mixing weighs by the languages that the first stage tells.  An empty table passes through every stage; null texts are rejected by the
first one; further columns of ``documents`` pass through up to the last stage, whatever their names; rows that repeat
an id are judged by their own texts; ties go to the smallest doc_id; texts of any length pass whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latticeframe.llm._shared import bounded_batches, fresh_path, remove, scratch
from latticeframe.llm.decontaminate import drop_contaminated
from latticeframe.llm.language_id import learn, prediction
from latticeframe.llm.mixing import mix
from latticeframe.llm.near_dedup import drop_near_duplicates
from latticeframe.llm.token_output import tokens_round_trip, word_tokenizer


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sets ``lang`` to the language that the text tells, by which ``mixing`` weighs; rejects documents without any letter, and only those.

    The labels that come in are learned from, and one that no row could be learned for stays.  Where no model can be fitted
    all are ``und``; those with a letter stay, with their labels.
    """
    bounded_batches(spark)
    model = learn(docs)
    held = docs.select(F.struct("*").alias("doc"), prediction(spark, model).alias("told"))
    lang, told = F.col("doc.lang"), F.col("told.lang_pred")
    kept = (told != "und") | F.coalesce(F.col("doc.text").rlike("\\p{L}"), F.lit(False))
    learned = lang.isNull() | lang.isin(model.languages if model else [])
    lang = F.when((told != "und") & learned, told).otherwise(lang)
    return held.where(kept).select(F.col("doc").withField("lang", lang).alias("doc")).select("doc.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays (five-word shingles, similarity .8 or more)."""
    return drop_near_duplicates(docs, width=5, similarity=0.8)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return drop_contaminated(docs, benchmark)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Draws four fifths of the tokens, with shares of source, language and topic tempered towards the rare ones."""
    return mix(docs, temper=0.7, budget=0.8)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token shards with Elias-Fano boundaries; returns what the files hold of each document."""
    return tokens_round_trip(docs, word_tokenizer(), end_id=2, pieces=True)


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("mixing", mixing), ("token_output", token_output)]

#: Language models, random walks and raking are not expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = fresh_path(spark, f"pipeline-{name}")
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if last:
            remove(spark, last)
        docs, last = spark.read.parquet(path), path
    return docs
