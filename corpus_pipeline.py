"""The corpus pipeline: stages that each take the documents the one before kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seawake.llm import decontamination, ngram_join, packing, pii, toxicity
from seawake.llm.common import read, small_batches, tidy_shuffles
from seawake.llm.queries import tokenizer_file
from seawake.session import release_stored, stored, stored_count

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain does not reject; the chain is fitted on those of
    ``docs`` that ``labels`` covers. All columns stay, and repeated rows."""
    return toxicity.keep_clean(docs, read(spark, sf_dir, "labels"))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies stays: of the document with the smallest doc_id, and
    of its repeated rows the greatest. Rows without doc_id take part with a number made of
    their text, above those of all others, so that they go before documents with one."""
    own = F.expr("coalesce(doc_id, (xxhash64(text) & 2305843009213693951L) | 4611686018427387904L)")
    keyed = docs.withColumn("_key", own)
    groups = ngram_join.similar_groups(keyed.select(F.col("_key").alias("doc_id"), "text"), percent=75, width=5)
    found = groups.groupBy(F.col("doc_id").alias("_key")).agg(F.min("component_id").alias("_first"), F.count("*").alias("_rows"))
    found = found.where("_rows > 1 OR _first <> _key")
    left = keyed.join(found, "_key", "left").where("_first IS NULL OR _first = _key")
    again = left.where("_rows > 1").groupBy("_key").agg(F.max(F.struct(docs.columns)).alias("_row")).select("_row.*")
    return left.where("_rows IS NULL OR _rows = 1").select(docs.columns).union(again)


def without_test_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no copy of a test item. Documents without doc_id stay."""
    drop = decontamination.contaminated(docs, read(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    return docs.join(drop, "doc_id", "left_anti").select(docs.columns)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data masked."""
    return pii.mask_personal_data(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in training sequences."""
    return packing.pack(docs, tokenizer_file("byte_bpe_50k.json"), end_id=0, capacity=2048)


def _thrifty(stage: Stage) -> Stage:
    """The stage in small Arrow batches. Its rows are asked for after it has returned, so that its
    caller's session keeps the setting, unless that is ``run``."""

    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        small_batches(spark)
        return stage(spark, docs, sf_dir)

    return run_stage


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", _thrifty(without_toxic)),
    ("n-gram Jaccard join", _thrifty(one_of_each_group)),
    ("benchmark decontamination", _thrifty(without_test_items)),
    ("PII", _thrifty(without_personal_data)),
    ("best-fit packing", _thrifty(packed)),
]

#: SQL cannot express the stages; tests hold them against plain versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to ``documents``, each written as a table and read by the next. What
    a stage has read or stored itself is removed once its own table is there.

    Null or empty texts pass the filters and are packed as one token; rows without doc_id are
    judged by their text alone; an empty table gives no rows; extra columns stay up to the
    last stage, whatever their names."""
    docs, first = read(spark, sf_dir, "documents"), stored_count()
    with tidy_shuffles(spark):
        for name, stage in STAGES[:-1]:
            docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
            release_stored(spark, first, keep_last=1)
        return STAGES[-1][1](spark, docs, sf_dir)
