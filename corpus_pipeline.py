"""A pipeline from raw documents to tokens, each stage by one operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from trigpoint.llm import bpe, common, decontam, jaccard, langid, queries, rules


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are in none of the languages that occur among labelled ones go; null and letterless texts are among them."""
    model = langid.learn(docs, queries.vocabulary("byte_bpe_multi_50k.tiktoken"), ~(queries.remainder(4) == 2))
    return langid.keep_known(docs, model)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the policy go; null and empty texts have too few words."""
    return rules.keep_good(docs, "web-1")


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the least id stays, and of repeated rows one."""
    return jaccard.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go. An item without words is in none."""
    return decontam.drop_contaminated(docs, queries.table(spark, sf_dir, "benchmark"))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of the ids of each document, and of what they decode to. A null text would count as an empty one."""
    return bpe.digests(docs, queries.vocabulary("byte_bpe_multi_50k.tiktoken"), queries.pattern())


STAGES = [("language_id", language_id), ("quality_rules", quality_rules), ("ngram_jaccard", ngram_jaccard), ("decontaminate", decontaminate), ("byte_bpe", byte_bpe)]

#: SQL can't express language ID and BPE.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's rows are written to the shared folder and read again."""
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.staged(stage(spark, docs, sf_dir), name)
    return docs
