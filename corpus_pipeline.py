"""The corpus pipeline: quality rules, quality classifier, near-duplicates, substring deduplication, packing.

Each stage is (name, function); a function takes the session, the rows that its predecessor kept and the
folder of tables, and returns a DataFrame. All but the last return the columns of documents.

Defined results: null, empty and very short texts fail the quality rules' base rule and go at once; rows without an id are judged like others,
linked with nothing and packed; repeated rows with one id are one document to the near-duplicate stage, so all stay or go together; with no labels the first two
stages reject by the base rule alone; extra columns, whatever their names, pass unchanged up to packing, which does not read them; an empty table gives no pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from crossgrid.llm import importance, near_dup, packing, quality_rules, substring_dedup
from crossgrid.llm.common import stash, table
from crossgrid.llm.queries import tokenizer


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.quality_filter(docs, table(spark, sf_dir, "labels"))


def classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return importance.importance_filter(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dup.keep_one(docs, shingle=5, percent=80)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_dedup(docs, report=False)


def packs(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer("word_bpe_49k.json"))


STAGES = [("quality_rules", rules), ("quality_classifier", classifier), ("near_duplicates", near_duplicates), ("substring_dedup", substrings), ("packing", packs)]

#: SQL expresses neither certified cutoffs, Gumbel noise, chosen paths nor gear hashes; tests/llm hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
