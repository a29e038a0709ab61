"""From raw documents to token files: quality rules, near-dedup, decontamination, mixing, token output.

Each stage takes (spark, docs, sf_dir) and gets the Parquet table that its predecessor wrote. All stages take whole texts of any
length, pass on extra columns whatever their names, and give an empty table for an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import classifier, decontam, mixing, rules, simhash, tokens
from millrace.llm.common import new_folder
from millrace.llm.queries import table, vocabulary


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule or the learned decision list rejects go; so do null and empty texts. Repeated rows are judged alike."""
    return rules.keep_good(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component stays, that of the least id; of rows that repeat, one. Texts without words are one component."""
    return simhash.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a window of a benchmark item occurs go. Null and empty texts, and all if there are no items, stay."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are left out or repeated so that sources come to their target weights, those of good quality first. Texts without words are left out."""
    scored, score = classifier.fit(docs, table(spark, sf_dir, "labels")).with_scores(docs)
    return mixing.mixed(scored, quality=F.col(f"`{score}`")).select(*(F.col(f"`{c}`") for c in docs.columns))


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bit-plane token files, and their digests read back; a row for each row, in order of id."""
    return tokens.read_digests(tokens.write_tokens(docs, vocabulary()))


STAGES = [("quality_rules", quality), ("simhash_near_dedup", near_dedup), ("decontaminate", decontaminate), ("mix_sources", mix_sources), ("token_output", write_tokens)]

ORACLE_SQL = None  # SimHash components, the learned rules and the tokenizer are beyond SQL; tests compare with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = new_folder(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        place = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(place)
        docs = spark.read.parquet(place)
    return docs
